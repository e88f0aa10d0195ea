"""Names of licences, heads of licence files and SPDX lines; labels against a search for every phrase at every place."""

import random
from collections import Counter

import pytest

from discern.llm import license_scan

CASES = {
    "This code is under GNU General Public License v3.0, see COPYING.": {"gpl-3"},
    "BSD 3-Clause License": {"bsd-3-clause"},
    "/* SPDX-License-Identifier: Apache-2.0 */": {"apache-2"},
    "// SPDX-License-Identifier: MIT OR Apache-2.0": {"mit", "apache-2"},
    "# SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2"},
    "# SPDX-License-Identifier: LGPL-2.1-only": {"lgpl-2.1"},
    "<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->": {"cc-by-sa"},
    "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999": {"lgpl-2.1"},
    "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/": {"apache-2"},
    "released under the GPLv3": {"gpl-3"},
    "Mozilla Public License Version 2.0\n====": {"mpl-2"},
    "The SPDX identifier of a license": set(),
    "Apache 2.0 was released in 2004 and the license of version 3 followed": set(),
    "GNU is not Unix; the general public reads version 3 of its license": set(),
}


@pytest.fixture(scope="module")
def index():
    # every licence word about as common as it is in prose: short ones often, long ones hardly
    n = len(license_scan.VOCABULARY)
    return license_scan.index_from({i: max(1, 2_000 // 4 ** len(w)) for i, w in enumerate(license_scan.VOCABULARY)} | {n: 1_000})


def labels(text, index):
    return {label for label, *_ in license_scan.matches(license_scan.words(text.encode()), index)}


@pytest.mark.parametrize("text", CASES)
def test_names_and_lines(text, index):
    assert labels(text, index) == CASES[text]
    filler = "some other words stand here and the text goes on under the line "
    assert labels(filler * 20 + "\n" + text + "\n" + filler * 20, index) == CASES[text]


def brute(ws):
    """Each template laid over each place of the file, without an index."""
    found = set()
    for label, text, phrases in license_scan._TEXTS:
        for at in range(-license_scan.SLIP, len(ws)):
            part = ws[max(0, at - license_scan.SLIP) : max(0, at + len(text) + license_scan.SLIP)]
            line = b" " + b" ".join(part) + b" "
            if all(b" " + p + b" " in line for p in phrases) and sum((Counter(text) & Counter(part)).values()) >= license_scan.LEAST_COVER * len(text):
                found.add(label)
                break
    return found


def test_labels_match_brute_force(index):
    rng = random.Random(5)
    texts = [t for _, t, _ in license_scan.TEMPLATES] + [n for names in license_scan.NAMES.values() for n in names] + [f"SPDX-License-Identifier: {i}" for i in license_scan.IDENTIFIERS.values()]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            ws = rng.choice(texts).split()
            ws = [w for w in ws if rng.random() > 0.04]
            words += rng.choices(["software", "license", "the", "under", "version", "2", "public", "any"], k=rng.randrange(12)) + ws
        text = " ".join(words)
        assert labels(text, index) == brute(license_scan.words(text.encode())), text
