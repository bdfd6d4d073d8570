"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are grouped under upper nodes, each a masked bit pattern that all members share: the root fixes no bit, and
a node's children fix one of max_diff + 1 blocks of its free bits each. Two fingerprints that differ in at most max_diff
bits agree on a whole block, so they meet under some child, at every depth; a node is split further only while it holds
over REFINE_OVER fingerprints. Under a node the fingerprints lie in order of their Gray rank, where similar patterns
are neighbours. Runs of that order form the lower nodes of the index (mask of the agreeing bits, pattern), runs of nodes
the levels above, and a pair of nodes is dropped whole when the differences accumulated over its common mask exceed the
budget, or when all its members are linked already.

Links leave a task as a spanning forest, never as all pairs, and components grow by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

REFINE_OVER = 200_000
FAN = 16


def fingerprint(data: bytes, width: int = 3, step: int = 1 << 16) -> int:
    """The 64-bit fingerprint of a text in UTF-8: ASCII-lower-cased words, shingles of `width` words, XXH64 with seed 42,
    a bit set where over half the shingles set it. No word: 0; fewer words than width: one shingle of all."""
    import numpy as np
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    last = np.minimum(np.arange(n) + width, len(words)) - 1
    end, ones, digest = begin[last] + size[last], np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, step):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(begin[i : min(i + step, n)].tolist(), end[i : i + step].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            fps = np.array([fingerprint(x.as_py() or b"", width) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), shared.text_of(docs, text).cast("binary").alias("t")).mapInArrow(shared.lean(run), "doc_id long, fp long")


def gray_rank(fp):
    """The position of each bit pattern in the reflected Gray sequence (numpy uint64)."""
    import numpy as np

    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _settle(label, i, j):
    """Merge the components of i and j in the label array (each label the smallest index reached)."""
    import numpy as np

    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        off = low != high
        if not off.any():
            return label
        i, j = i[off], j[off]
        np.minimum.at(label, high[off], low[off])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def link_group(fp, max_diff: int = 3):
    """Component labels (smallest index) of one group's fingerprints, which come in Gray order."""
    import numpy as np

    n = len(fp)
    label = np.arange(n)
    levels = [(fp, fp)]  # AND and OR of each node's members
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        cut = np.arange(0, len(low), FAN)
        levels.append((np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)))
    # Neighbours in Gray order first: what they link prunes most pairs of nodes below.
    near = np.flatnonzero(np.bitwise_count(fp[1:] ^ fp[:-1]) <= max_diff)
    label = _settle(label, near, near + 1)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, a, b = stack.pop()
        low, high = levels[depth]
        if depth == 0:
            hit = np.bitwise_count(fp[a] ^ fp[b]) <= max_diff
            label = _settle(label, a[hit], b[hit])
            continue
        agree_a, agree_b = ~(low[a] ^ high[a]), ~(low[b] ^ high[b])
        common = agree_a & agree_b
        least = np.bitwise_count((low[a] ^ low[b]) & common)
        keep = least <= max_diff
        reach = FAN**depth  # members of a node lie in [k * reach, (k + 1) * reach)
        first, stop = np.arange(0, n, reach), np.minimum(np.arange(0, n, reach) + reach, n) - 1
        lo_label, hi_label = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
        keep &= ~((lo_label[a] == hi_label[a]) & (lo_label[b] == hi_label[b]) & (lo_label[a] == lo_label[b]))
        a, b = a[keep], b[keep]
        alike = least[keep] + np.bitwise_count(~common[keep]) <= max_diff  # all members of both are in reach of each other
        if alike.any():
            for x, y in zip(a[alike].tolist(), b[alike].tolist(), strict=True):
                own = np.concatenate([np.arange(first[x], stop[x] + 1), np.arange(first[y], stop[y] + 1)])
                label = _settle(label, own[:-1], own[1:])
            a, b = a[~alike], b[~alike]
        below = len(levels[depth - 1][0])
        for k in range(0, len(a), 2048):
            ca = (a[k : k + 2048, None, None] * FAN + np.arange(FAN)[None, :, None]) + np.zeros((1, 1, FAN), np.int64)
            cb = (b[k : k + 2048, None, None] * FAN + np.arange(FAN)[None, None, :]) + np.zeros((1, FAN, 1), np.int64)
            ca, cb = ca.ravel(), cb.ravel()
            ok = (ca < below) & (cb < below) & ((ca < cb) | ((ca == cb) & (depth > 1)))
            if ok.any():
                stack.append((depth - 1, ca[ok], cb[ok]))
    return label


def _free_blocks(mask: int, n: int) -> list[int]:
    """n disjoint masks that cover the bits outside mask, from the highest down."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / n) for i in range(n + 1)]
    return [sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(nodes: DataFrame, masks: list[int], n: int) -> tuple[DataFrame, list[int]]:
    """The children of nodes (mask, pattern, fp, rep), whose masks are among the given ones."""
    table = {m: [m | c for c in _free_blocks(m, n)] for m in masks}
    options = F.create_map(*[x for m, kids in table.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in kids]))])
    out = nodes.select(F.explode(options[F.col("mask")]).alias("mask"), "fp", "rep")
    return out.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("pattern"), "fp", "rep"), sorted({k for kids in table.values() for k in kids})


def _links(nodes: DataFrame, max_diff: int) -> DataFrame:
    """u, v (u > v): a spanning forest of the links under each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list = []

        def solve(mask, pattern, fp, rep):
            order = np.lexsort((gray_rank(fp), pattern, mask))
            mask, pattern, fp, rep = mask[order], pattern[order], fp[order], rep[order]
            start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
            size = np.diff(np.r_[start, len(mask)])
            group = np.repeat(np.arange(len(start)), size)
            label = np.arange(len(fp))
            few = size[group] <= 64
            for k in range(1, min(64, int(size.max(initial=1)))):
                i = np.flatnonzero(few[:-k] & (group[k:] == group[:-k]) & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= max_diff))
                label = _settle(label, i, i + k)
            for g in np.flatnonzero(size > 64).tolist():
                own = slice(start[g], start[g] + size[g])
                label[own] = link_group(fp[own], max_diff) + start[g]
            u, v = rep, rep[label]
            off = u != v
            u, v = np.maximum(u, v)[off], np.minimum(u, v)[off]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        def arrays(b):
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            return c[0], c[1], c[2].view(np.uint64), c[3]

        for b in batches:  # sorted by node: only the last node of a batch can go on in the next
            if not b.num_rows:
                continue
            cols = arrays(b)
            if held:
                cols = tuple(np.concatenate([h[i] for h in [*held, cols]]) for i in range(4))
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield solve(*(c[:cut] for c in cols))
            held = [tuple(c[cut:] for c in cols)]
        if held:
            yield solve(*held[0])

    return nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern").mapInArrow(run, "u long, v long")


def near_links(distinct: DataFrame, max_diff: int = 3, refine_over: int = REFINE_OVER) -> DataFrame:
    """Links u, v between the representatives of distinct fingerprints (fp, rep), enough to connect all that are linked."""
    nodes = distinct.where("rep is not null").select(F.lit(0).cast("long").alias("mask"), "fp", "rep")
    masks, found = [0], None
    while True:
        nodes, masks = _split(nodes, masks, max_diff + 1)
        counts = shared.written(nodes.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > refine_over).select(F.col("mask").alias("m"), F.col("pattern").alias("p")), "simhash-large")
        large = [] if not counts.limit(1).count() else [m & (2**64 - 1) for (m,) in counts.select("m").distinct().collect() if (m & (2**64 - 1)).bit_count() < 64 - max_diff]
        if not large:
            links = _links(nodes, max_diff)
            return links if found is None else found.unionByName(links)
        counts = shared.small(counts.where(F.col("m").isin([_signed(m) for m in large])))
        same = (F.col("mask") == F.col("m")) & (F.col("pattern") == F.col("p"))
        links = _links(nodes.join(counts, same, "left_anti"), max_diff)
        found = links if found is None else found.unionByName(links)
        nodes, masks = shared.written(nodes.join(counts, same, "left_semi"), "simhash-nodes"), large


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, label (the smallest node reachable) for all nodes of links (u, v). Each round takes the smallest label among
    a node's neighbours and then the label's own label, until nothing changes; labels are written every round."""
    links = shared.written(links.distinct(), f"{name}-links")
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = shared.written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    while True:
        far = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("l"))
        step = labels.join(far, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("was"))
        step = shared.written(step, f"{name}-step")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = shared.written(step.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("was")).alias("moved")), name)
        moved = new.where("moved").limit(1).count()
        shared.forget(step)
        shared.forget(labels)
        labels = new
        if not moved:
            return labels.select("node", "label")


def near_dedup(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", width: int = 3, max_diff: int = 3, refine_over: int = REFINE_OVER) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached by
    links of at most max_diff differing bits, itself included).

    Null and empty texts, and those of white space, have fingerprint zero and are linked like any other. A null id takes
    the component of its fingerprint's other rows (null if there is none) and carries no links of its own. Rows equal in
    id are one document. An empty table gives no rows; other columns are not read."""
    rows = shared.written(fingerprints(docs, text=text, id_col=id_col, width=width), "simhash-fp")
    distinct = shared.written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    labels = components(near_links(distinct, max_diff, refine_over), "simhash-components")
    of_fp = distinct.join(labels, distinct["rep"] == labels["node"], "left").select(F.col("fp").alias("f"), F.coalesce("label", "rep").alias("component_id"))
    out = rows.join(of_fp, rows["fp"] == F.col("f"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
