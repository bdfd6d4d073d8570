"""Token ids in a content-addressed store.

A store is a folder of Parquet tables:
  objects/kind=c   key (BLAKE2b-128 of the payload), body (the chunk's ids, little-endian, 2 bytes each if the
                   vocabulary allows, else 4), n_tokens: each distinct chunk once
  recipes          one row per document in ascending doc_id order: doc_id, n_tokens, root (Merkle root over its chunk
                   keys), body (chunk key and length, repeated), chain (hash chain over the roots of its part)
  manifest         a row per part of recipes: rows, tokens, offset of its first id, chain of its last row, and the
                   Merkle root over all parts
  meta             id width, chunking parameters, end id, digest of the tokenizer

Chunks are cut where a rolling hash over the last 8 ids has its top bits zero, so an edit moves only the cuts near it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MIN_IDS, CUT_BITS, MAX_IDS = 128, 8, 2048
KEY = 16
CACHE_WORDS = 300_000
#: A Latin letter, then closing ASCII marks and the end of a piece.
CLOSING = "([A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}])([!-/:-@\\[-`{-~]+)(\\x00|\\z)"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd last node moves up as it is; no leaf: the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def byte_marks() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, and the other
    bytes follow from code point 256 on."""
    itself = [b for b in range(256) if chr(b).isprintable() and b != 32 and not 127 <= b <= 160 and b != 173]
    others = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes whole texts with a tokenizers file. For a byte-level BPE with the usual word pattern, a word's ids do not
    depend on its neighbours: such texts are cut at single spaces and newlines in Arrow, the distinct pieces of a batch
    are looked up once, and pieces not met before go to the library together, joined by what they were cut at. Texts that
    hold other white space, or an added token's string, go to the library whole. Closing ASCII marks after a letter are a
    unit of the word pattern by themselves, so a word and its marks are looked up apart."""

    def __init__(self, tokenizer_json: str) -> None:
        import numpy as np
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        pre, added = spec.get("pre_tokenizer") or {}, [t["content"] for t in spec.get("added_tokens") or []]
        by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.by_word = bool(by_word) and not any(c.isspace() for t in added for c in t)
        spaces = "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
        self.odd = "|".join([r"\A[ \n]", r"[ \n]\z", "[ \n][ \n]", rf"[\x00{spaces}]", *("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in added if t)])
        mark, known = byte_marks(), self.tokenizer.get_vocab()
        self.opens, self.is_line = np.zeros(max(known.values(), default=0) + 1, bool), np.zeros(max(known.values(), default=0) + 1, bool)
        self.opens[[i for t, i in known.items() if t.startswith(mark[32])]] = True
        self.is_line[[i for t, i in known.items() if mark[10] in t]] = True
        self.words, self.met = pa.array([""], pa.large_string()), np.zeros(1, np.int64)  # pieces met, and in which batch last
        self.ids, self.size, self.batch = np.zeros(0, self.dtype), np.zeros(1, np.int64), 0

    def plain(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text."""
        import numpy as np

        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [np.array(x, self.dtype).tobytes() for x in ids]

    def encode(self, texts) -> list[bytes]:
        """The ids of each text (a list or an Arrow array) as packed integers of self.dtype; null counts as empty."""
        import numpy as np
        import pyarrow.compute as pc

        col = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(col, self.odd).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(col), bool)
        plain = iter(self.plain(col.filter(pa.array(whole)).to_pylist()))
        marked = pc.replace_substring(pc.replace_substring(col.filter(pa.array(~whole)), "\n", "\0\n\0"), " ", "\0 ")
        pieces = pc.split_pattern(pc.replace_substring_regex(marked, CLOSING, "\\1\0\\2\\3"), "\0")
        flat = pieces.flatten().dictionary_encode()
        code = self.look_up(flat.dictionary)[flat.indices.to_numpy()]
        n = self.size[code]
        upto = np.cumsum(n)
        at = np.repeat((np.cumsum(self.size) - self.size)[code] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)
        stop = np.r_[0, upto][pieces.offsets.to_numpy() - (pieces.offsets[0].as_py() if len(pieces) else 0)] * self.ids.itemsize
        packed = self.ids[at].tobytes()
        cut = (packed[a:b] for a, b in itertools.pairwise(stop.tolist()))
        return [next(plain) if w else next(cut) for w in whole.tolist()]

    def look_up(self, pieces: pa.Array):
        """Where distinct pieces are among the words; new ones are learned. Of more than CACHE_WORDS, those that the last
        two batches had stay, so frequent ones do."""
        import numpy as np
        import pyarrow.compute as pc

        self.batch += 1
        if len(self.words) > CACHE_WORDS:
            keep = self.met >= self.batch - 2
            self.ids = self.ids[np.repeat(keep, self.size)]
            self.words, self.met, self.size = self.words.filter(pa.array(keep)), self.met[keep], self.size[keep]
        at = pc.fill_null(pc.index_in(pieces, self.words), -1).to_numpy().copy()
        line, spaced = pc.equal(pieces, "\n").to_numpy(zero_copy_only=False), pc.starts_with(pieces, " ").to_numpy(zero_copy_only=False)
        new = at < 0
        for which, before, first in ((spaced, "", self.opens), (~spaced & ~line, "\n", self.is_line), (line, None, None)):
            own = np.flatnonzero(new & which)
            for k in range(0, len(own), 50_000):
                at[own[k : k + 50_000]] = np.arange(len(own[k : k + 50_000])) + len(self.words)
                self.learn(pieces.take(pa.array(own[k : k + 50_000])), before, first)
        self.met[at] = self.batch
        return at

    def learn(self, pieces: pa.Array, before: str | None, first) -> None:
        """Encode many pieces in one text: a piece begins at each id of `first`, which is its own or the newline before."""
        import numpy as np

        if before is not None:
            text = before + before.join(pieces.to_pylist())
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            begin = np.flatnonzero(first[ids])
        if before is None or len(begin) != len(pieces):  # not the word pattern that this takes it for
            each = self.plain(pieces.to_pylist())
            ids, size = np.frombuffer(b"".join(each), self.dtype), np.array([len(x) for x in each]) // self.ids.itemsize
        else:
            size = np.diff(np.r_[begin, len(ids)]) - len(before)
            ids = ids[~first[ids]] if before else ids
        self.words = pa.concat_arrays([self.words, pieces])
        self.ids, self.size, self.met = np.r_[self.ids, ids].astype(self.dtype), np.r_[self.size, size], np.r_[self.met, np.full(len(size), self.batch)]


def slices(batch: pa.RecordBatch, column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` bytes in a text column, or one row that is longer."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def cut_points(ids) -> list[int]:
    """Ends of the chunks of an id array."""
    import numpy as np

    n = len(ids)
    if n <= MIN_IDS:
        return [n]
    m = 0x9E3779B1
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    for k in (1, 2, 4):  # the hash over 2k ids from those over k
        h[k:] = h[k:] + h[:-k] * np.uint32(pow(m, k, 1 << 32))
    ends, last = [], 0
    for i in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while i - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if i - last >= MIN_IDS:
            ends.append(i)
            last = i
    while n - last > MAX_IDS:
        last += MAX_IDS
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, *, text: str = "text", id_col: str = "doc_id") -> None:
    """Encode every whole text of docs, end_id after each, into a store at path.

    Null text counts as empty: such a document is the end id alone. Null ids sort first; repeated rows are documents of
    their own and share their chunks. An empty table makes an empty store."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        state = shared.worker_state()  # words encoded by a worker's earlier tasks stay at hand
        if state.get("tokenizer") != shipped.value:
            state |= {"tokenizer": shipped.value, "encoder": Encoder(shipped.value)}
        encoder, part, row, seen = state["encoder"], TaskContext.get().partitionId(), 0, set()
        end, width = np.array([end_id], encoder.dtype).tobytes(), np.dtype(encoder.dtype).itemsize
        for b in batches:
            for some in slices(b, 1):
                out: list = [[], [], [], [], [], []]
                for doc_id, packed in zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True):
                    packed += end
                    recipe, keys, last = [], [], 0
                    for stop in cut_points(np.frombuffer(packed, encoder.dtype)):
                        body = packed[last * width : stop * width]
                        key = digest(body)
                        keys.append(key)
                        recipe += [key, (stop - last).to_bytes(4, "little")]
                        if key not in seen:
                            seen.add(key)
                            for c, v in zip(out, ("c", key, None, stop - last, None, body), strict=True):
                                c.append(v)
                        last = stop
                    for c, v in zip(out, ("r", digest(f"{part}:{row}".encode()), doc_id, last, merkle_root(keys), b"".join(recipe)), strict=True):
                        c.append(v)
                    row += 1
                    if len(seen) > 200_000:
                        seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "key", "doc_id", "n_tokens", "root", "body"])

    made = docs.select(docs[id_col].cast("long").alias("doc_id"), shared.text_of(docs, text).alias("t")).mapInArrow(shared.lean(run), "kind string, key binary, doc_id long, n_tokens long, root binary, body binary")
    # Map-side combined: a chunk that every document holds leaves each task once.
    once = made.groupBy("kind", "key").agg(F.first(F.struct("doc_id", "n_tokens", "root", "body")).alias("v")).select("key", "v.*", "kind")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")

    schema = "key binary, doc_id long, n_tokens long, root binary, body binary, kind string"
    recipes = spark.read.schema(schema).parquet(f"{path}/objects").where("kind = 'r'").select("doc_id", "n_tokens", "root", "body")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, total, row, last = TaskContext.get().partitionId(), 0, 0, b""
        for b in batches:
            links = []
            for root in b.column(2).to_pylist():
                last = digest(last + root)
                links.append(last)
            ends = np.cumsum(b.column(1).to_numpy()) + total
            own = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(ends - b.column(1).to_numpy()), pa.array(np.arange(row, row + b.num_rows)), pa.array(links, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=["doc_id", "n_tokens", "root", "body", "part", "at", "row", "chain"])
            total, row = int(ends[-1]) if len(ends) else total, row + b.num_rows

    order = ["doc_id", "n_tokens", "root"]
    ranged = recipes.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(chain, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    parts = spark.read.schema(RECIPES).parquet(f"{path}/recipes").groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.max_by("chain", "row").alias("chain"))
    rows = sorted(parts.collect())  # a row for each partition
    offset, out = 0, []
    root = merkle_root([bytes(r.chain) for r in rows])
    for r in rows:
        out.append((r.part, r.rows, r.tokens, offset, bytes(r.chain), root))
        offset += r.tokens
    spark.createDataFrame(out, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    meta = [(Encoder(tokenizer_json).dtype, end_id, MIN_IDS, CUT_BITS, MAX_IDS, hashlib.sha256(tokenizer_json.encode()).hexdigest())]
    spark.createDataFrame(meta, "dtype string, end_id int, min_ids int, cut_bits int, max_ids int, tokenizer string").coalesce(1).write.parquet(f"{path}/meta")


RECIPES = "doc_id long, n_tokens long, root binary, body binary, part int, at long, row long, chain binary"
MANIFEST = "part int, rows long, tokens long, offset long, chain binary, root binary"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """A row per chunk of each document: doc_id, start, n_tokens, nth, key, tail (ids of the document after the chunk).
    Every recipe must give its Merkle root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            ids, starts, sizes, roots, bodies = (c.to_pylist() for c in b.columns)
            for k in range(0, len(ids), 256):
                out: list = [[], [], [], [], [], []]
                for doc_id, start, n, root, body in zip(*(c[k : k + 256] for c in (ids, starts, sizes, roots, bodies)), strict=True):
                    keys = [body[i : i + KEY] for i in range(0, len(body), KEY + 4)]
                    if merkle_root(keys) != root:
                        raise ValueError(f"the recipe of document {doc_id} does not give its Merkle root")
                    each = np.frombuffer(body, np.dtype([("k", f"V{KEY}"), ("n", "<u4")]))["n"].astype(np.int64)
                    tail = n - np.cumsum(each)
                    for c, v in zip(out, ([doc_id] * len(keys), [start] * len(keys), [n] * len(keys), range(len(keys)), keys, tail.tolist()), strict=True):
                        c.extend(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "start", "n_tokens", "nth", "key", "tail"])

    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select(F.col("part").alias("p"), "offset")
    placed = recipes.join(shared.small(manifest), F.col("part") == F.col("p"), "left")
    offset = F.coalesce("offset", F.raise_error(F.lit("a part of the recipes is not in the manifest")).cast("long"))
    return placed.select("doc_id", (F.col("at") + offset).alias("start"), "n_tokens", "root", "body").mapInArrow(shared.lean(run), "doc_id long, start long, n_tokens long, nth int, key binary, tail long")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    schema = "key binary, doc_id long, n_tokens long, root binary, body binary, kind string"
    return spark.read.schema(schema).parquet(f"{path}/objects").where("kind = 'c'").select("key", "n_tokens", "body")


def _dtype(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/meta").first()["dtype"]


def _checked(key: bytes, body: bytes) -> bytes:
    if digest(body) != key:
        raise ValueError(f"chunk {key.hex()} does not have its content")
    return body


def crc_advance(crc, n_ids):
    """The crc32 that crc (numpy uint32) contributes when n_ids 32-bit words follow: with it, the checksum of a document
    is the exclusive or over its chunks. Advancing is linear over bits, so powers of two of it are tables."""
    import numpy as np

    def times(op, x):
        out = np.zeros_like(x)
        for bit in range(32):
            out ^= np.where(x >> np.uint32(bit) & np.uint32(1), op[bit], np.uint32(0))
        return out

    op = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit
    for _ in range(5):  # 32 zero bits
        op = times(op, op)
    crc, n_ids = np.array(crc, np.uint32), np.array(n_ids, np.int64)
    while n_ids.any():
        odd = np.flatnonzero(n_ids & 1)
        crc[odd] = times(op, crc[odd])
        n_ids >>= 1
        op = times(op, op)
    return crc


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. The recipes must be those of the manifest.
    Every stored chunk is read, must have its content's key, and gives the checksum of its ids; a document's checksum is
    composed of its chunks', so no ids move between tasks. A missing chunk or part, or a length that differs, is an
    error."""
    dtype = _dtype(spark, path)
    verify_manifest(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        for b in batches:
            keys = b.column(0).to_pylist()
            ids = [np.frombuffer(_checked(k, v.as_py()), dtype) for k, v in zip(keys, b.column(2), strict=True)]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())], names=["k", "n", "crc"])

    def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            moved = crc_advance(b.column("crc").to_numpy().astype(np.uint32), b.column("tail").to_numpy())
            yield b.select(["doc_id", "start", "n_tokens", "n"]).append_column("crc", pa.array(moved.astype(np.int64)))

    chunk = _chunks(spark, path).mapInArrow(shared.lean(sums), "k binary, n long, crc long")
    there = F.coalesce("n", F.raise_error(F.lit("a document's chunk is not in the store")).cast("long")).alias("n")
    joined = _entries(spark, path).join(chunk, F.col("key") == F.col("k"), "left").select("doc_id", "start", "n_tokens", there, "crc", "tail")
    each = joined.mapInArrow(advanced, "doc_id long, start long, n_tokens long, n long, crc long")
    out = each.groupBy("doc_id", "start", "n_tokens").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("crc"))
    whole = F.when(F.col("n") == F.col("n_tokens"), F.col("crc")).otherwise(F.raise_error(F.lit("a document's chunks do not make up its length")).cast("long"))
    return out.select("doc_id", "start", "n_tokens", whole.alias("ids_crc32"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>) of each document, rebuilt from its chunks, with the checks of read_digests."""
    dtype = _dtype(spark, path)
    verify_manifest(spark, path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            ids = [np.concatenate([np.frombuffer(_checked(e["key"], e["body"]), dtype) for e in row.as_py()]).astype(np.int32) for row in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    there = F.coalesce("body", F.raise_error(F.lit("a document's chunk is not in the store")).cast("binary")).alias("body")
    joined = _entries(spark, path).join(_chunks(spark, path).select("key", "body"), "key", "left").withColumn("body", there)
    rows = joined.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("nth", "key", "body"))).alias("e"))
    return rows.mapInArrow(unpack, "doc_id long, start long, ids array<int>")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise if the recipes' roots, in order, do not give each part's chain, if a part's rows or tokens differ from the
    manifest's, if either has a part that the other lacks, or if the parts' chains do not give the manifest's root."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("part").collect()  # a row for each part
    want = spark.sparkContext.broadcast({r.part: (r.rows, r.tokens, bytes(r.chain)) for r in rows})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, seen = b"", (None, 0, 0), 0

        def whole():
            if now[0] is not None and want.value.get(now[0]) != (*now[1:], last):
                raise ValueError(f"part {now[0]} of the recipes is not as the manifest has it")
            return now[0] is not None

        for b in batches:
            for p, n, root, chain in zip(*(b.column(x).to_pylist() for x in ("part", "n_tokens", "root", "chain")), strict=True):
                if p != now[0]:
                    seen += whole()
                    last, now = b"", (p, 0, 0)
                last, now = digest(last + root), (p, now[1] + 1, now[2] + n)
                if last != chain:
                    raise ValueError(f"part {p} of the recipes does not give its chain")
        seen += whole()
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64())], names=["parts"])

    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", "n_tokens", "root", "chain", "row")
    parts = recipes.repartition("part").sortWithinPartitions("part", "row").mapInArrow(check, "parts long").agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    if parts != len(rows) or any(bytes(r.root) != merkle_root([bytes(x.chain) for x in rows]) for r in rows):
        raise ValueError("the manifest does not give its root, or has other parts than the recipes")
