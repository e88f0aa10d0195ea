import random

from discern.llm import license_scan


def test_a_file_that_holds_every_template():
    rng = random.Random(3)
    index = license_scan.index_from({i: rng.randrange(1, 50) for i in range(len(license_scan.VOCABULARY))} | {len(license_scan.VOCABULARY): 1000})
    for _ in range(5):
        texts = [t for _, t, _ in license_scan.TEMPLATES]
        rng.shuffle(texts)
        ws = license_scan.words("\n\nSome other words stand here.\n\n".join(texts).encode())
        found = license_scan.matches(ws, index)
        assert {label for label, *_ in found} == {label for label, *_ in license_scan.TEMPLATES}
        assert len(found) == len(license_scan.TEMPLATES)
