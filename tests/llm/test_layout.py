"""How documents are dealt to chunks and buckets, and spans of personal data in long texts."""

import time

import pytest

from pagecensus.llm import buckets, pii


@pytest.mark.parametrize("docs, size", [(0, 0), (1, 10), (1000, 2_500_000), (51_282, 54_000_000), (256_410, 900_000_000), (10, 10**9)])
@pytest.mark.parametrize("tasks", [8, 422, 4000])
def test_layout_follows_the_data(docs, size, tasks):
    chunks, bits = buckets.layout(docs, size, tasks, buckets.CHUNK_DOCS)
    assert docs <= chunks * buckets.CHUNK_DOCS and size <= chunks * buckets.CHUNK_BYTES
    assert size <= 2**bits * buckets.BUCKET_BYTES
    # Nothing is cut finer than its size is worth, however many tasks there could be.
    assert chunks <= max(1, -(-docs // buckets.FEW_DOCS), -(-size // buckets.CHUNK_BYTES))
    assert 2**bits < 2 * max(1, -(-size // buckets.FEW_BYTES))


def by_definition(spans):
    """Of two that overlap, the first found."""
    taken = []
    for start, end, kind in spans:
        if all(end <= s or start >= e for s, e, _ in taken):
            taken.append((start, end, kind))
    return sorted(taken)


def test_overlapping_spans(monkeypatch):
    draw = __import__("random").Random(4)
    for _ in range(200):
        spans = [(s, s + draw.randint(1, 9), "number") for s in (draw.randint(0, 60) for _ in range(25))]
        monkeypatch.setattr(pii, "_digit_entities", lambda text, spans=spans: spans)
        assert pii.entities("x" * 80) == by_definition(spans)


def test_many_entities_in_one_text():
    text = " ".join(f"user{i}@mail{i}.example" for i in range(20_000))
    start = time.perf_counter()
    assert len(pii.entities(text)) == 20_000
    assert time.perf_counter() - start < 20


def test_secrets_of_any_length():
    for size in (8, 511, 512, 513, 700, 5000):
        secret = ("aB3x" * size)[:size]
        text, found = pii.replace(f"token = {secret} end", b"key")
        assert text.startswith("token = ") and text.endswith(" end") and len(text) == size + 12
        assert "".join(e for _, _, e, _ in found) == secret
        assert "aB3xaB3x" not in text
