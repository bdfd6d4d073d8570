import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import simhash

from .conftest import edge_rows


def naive(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def labels_of(fps: list[int], d: int = 3) -> list[int]:
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


@given(st.text(max_size=80))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode("utf-8", "ignore")) == naive(text.encode("utf-8", "ignore").decode())
    assert simhash.fingerprint(text.encode("utf-8", "ignore"), step=2) == simhash.fingerprint(text.encode("utf-8", "ignore"))


@pytest.mark.parametrize("n,centres,flips", [(90, 4, 3), (900, 40, 4), (1500, 2, 3), (700, 700, 0)])
def test_link_group_is_brute_force(n, centres, flips):
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        m = rng.random(n) < 0.6
        fp[m] ^= np.uint64(1) << rng.integers(0, 64, m.sum()).astype(np.uint64)
    fp = np.unique(fp)
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    assert simhash.link_group(fp).tolist() == labels_of([int(x) for x in fp])


@pytest.mark.parametrize("refine_over", [3, simhash.REFINE_OVER])
def test_components_are_brute_force(spark, edge_docs, refine_over):
    rows = edge_rows()
    fps = [naive(r[1] or "") for r in rows]
    label, least = labels_of(fps), {}
    for r, k in zip(rows, label):
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    # Rows of one id are one document.
    want = sorted((r[0] is not None, r[0] or 0, f"{fp:016x}", least.get(k)) for r, fp, k in zip(rows, fps, label))
    got = simhash.near_dedup(edge_docs, refine_over=refine_over).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == want


def test_no_rows(no_docs):
    assert simhash.near_dedup(no_docs).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)], "u long, v long")
    assert {r.label for r in simhash.components(links).collect()} == {0}
