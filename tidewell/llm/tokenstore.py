"""Operator 6: token ids in a content-addressed store.

Each document's ids (with the end id) are cut into chunks where a rolling hash of the last
``WINDOW`` ids ends in zeros, so equal passages give equal chunks wherever they stand. The store
has three Parquet tables in one folder:

* ``parts/kind=chunk``: hash (BLAKE2b, 16 bytes) and ids (little-endian, 2 bytes each if they
  fit, else 4; the first byte says which), each distinct chunk once;
* ``recipes``: in ascending doc_id order, file by file and row by row, the document's chunk
  hashes, its Merkle root over them, its number of ids, its start and its range of the order;
* ``manifest``: hashes of blocks of recipe rows (doc_id, start, n_tokens, root), of ranges over
  their blocks, and of the store over its ranges: the Merkle tree's upper levels.

Reading checks each chunk's hash, each document's root and the manifest over all recipes. The order's prefix sums run per range (see ``common``).
"""

from __future__ import annotations

import json
import os
import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Table, bounded_batches, delete, per_worker, shared_dir, with_prefix_sum

END, WINDOW, LEAST, MEAN_BITS, MOST, LEAF = 1, 16, 64, 9, 4096, 4096
CACHE = 800_000  # words whose ids a worker remembers, and chunks it has sent: about 100 MB
_BASE = 0x9E3779B97F4A7C15


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Of words of printable ASCII without the apostrophe and "<", and of Latin-1's letters, the
# tokenizer's pieces are the runs of letters, single digits and runs of signs of the word in lower
# case. UTF-8 has Latin-1's letters as C2 or C3 and one byte.
_ASCII = np.array([0x21 <= b <= 0x7E and b not in b"'<" for b in range(256)])
_AFTER_C2 = np.array([b in (0xAA, 0xB5, 0xBA) for b in range(256)])
_AFTER_C3 = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_KIND = np.array([0 if b == 0x0A else 1 if 0x61 <= b <= 0x7A or b >= 0x80 else 2 if 0x30 <= b <= 0x39 else 3 for b in range(256)], dtype=np.uint8)


class Encoder:
    """Ids of whole texts. The tokenizer's pieces never span white space, so ids of words are remembered.

    A batch of texts is split and its different words numbered by Arrow, which also finds those
    that are known; the ids of new words are appended to one array, and those of all texts are
    gathered from it. Where more than ``CACHE`` words are known, the half used last stays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for pieces that need no normalising: many at once, between spaces
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a piece
        self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        # words known, the place and number of their ids in the pool, and the batch that used them last
        self.words = pa.array([""])
        self.start, self.length, self.used = (np.zeros(1, dtype=np.int64) for _ in range(3))
        self.pool, self.clock = np.empty(0, dtype="<u4"), 0

    def _plain(self, new: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without odd characters and their number a word: all pieces at once, between spaces."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), "\n")[0].as_py()
        data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
        kind = _KIND[data]
        first = np.r_[True, kind[1:] != kind[:-1]] & (kind > 0) | (kind == 2)
        pieces = np.add.reduceat(first, np.r_[0, np.flatnonzero(kind == 0) + 1], dtype=np.int64)
        spaced = np.insert(data, np.flatnonzero(first), 0x20).tobytes().decode()
        ids = np.array(self.pieces.encode_batch_fast([spaced], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != pieces.sum():
            raise ValueError("the tokenizer does not mark the ends of pieces")
        return ids, np.diff(ends[np.cumsum(pieces) - 1], prepend=0)

    def _learn(self, new: pa.StringArray) -> np.ndarray:
        """Appends new words, which are not empty; returns their places."""
        offsets = np.frombuffer(new.buffers()[1], dtype=np.int32)[new.offset : new.offset + len(new) + 1]
        data = np.frombuffer(new.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        after = np.r_[data[1:], np.uint8(0)]
        lead = (data == 0xC2) & _AFTER_C2[after] | (data == 0xC3) & _AFTER_C3[after]
        plain_byte = _ASCII[data] | lead | np.r_[False, lead[:-1]]
        odd = np.add.reduceat(~plain_byte, offsets[:-1] - offsets[0], dtype=np.int64) > 0
        plain, rest = new.filter(pa.array(~odd)), new.filter(pa.array(odd))
        got = [self._plain(plain.slice(at, 8192)) for at in range(0, len(plain), 8192)]
        for at in range(0, len(rest), 8192):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(rest.slice(at, 8192).to_pylist(), add_special_tokens=False)]
            got.append((np.array([k for x in ids for k in x], dtype="<u4"), np.array(list(map(len, ids)))))
        length = np.concatenate([n for _, n in got])
        known, pooled = len(self.words), len(self.pool)
        self.words = pa.concat_arrays([self.words, plain, rest])
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in got)])
        self.length = np.r_[self.length, length]
        self.start = np.r_[self.start, pooled + np.cumsum(length) - length]
        self.used = np.r_[self.used, np.zeros(len(new), dtype=np.int64)]
        places = np.empty(len(new), dtype=np.int64)
        places[~odd] = known + np.arange(len(plain))
        places[odd] = known + len(plain) + np.arange(len(rest))
        return places

    def _forget(self) -> None:
        self.used[0] = self.clock + 1  # the empty word stays
        stay = np.sort(np.argsort(-self.used, kind="stable")[: CACHE // 2])
        length = self.length[stay]
        self.pool = self.pool[_runs(self.start[stay], length)]
        self.words, self.length, self.used = self.words.take(pa.array(stay)), length, self.used[stay]
        self.start = np.cumsum(length) - length

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none) and the end id."""
        if len(self.words) > CACHE:
            self._forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.string()), ""))
        numbered = lists.flatten().dictionary_encode()
        different = numbered.dictionary
        at = pc.fill_null(pc.index_in(different, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = at < 0
        if new.any():
            at[new] = self._learn(different.filter(pa.array(new)))
        self.clock += 1
        self.used[at] = self.clock
        word = at[numbered.indices.to_numpy()]
        own = self.length[word]
        ends = np.r_[0, np.cumsum(own)][np.cumsum(lists.value_lengths().to_numpy())] if len(lists) else []
        ids = self.pool[_runs(self.start[word], own)]
        end = np.array([END], dtype="<u4")
        return [np.concatenate([ids[a:b], end]) for a, b in zip([0, *ends], ends, strict=False)]


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of so many places, one run after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _larger(batches, size: int = 8 << 20):
    """Batches of ``size`` bytes or a little more: the fewer there are, the more of a batch's words are alike."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base's inverse and of the base, modulo 2**64."""
    n = 1 << 16
    return np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)), np.cumprod(np.full(n, _BASE, dtype=np.uint64))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of chunks: content-defined, ``LEAST`` to ``MOST`` ids each but for the last."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    # polynomial rolling hash modulo 2**64 over mixed ids: windows by differences of prefix sums
    inverse, power = per_worker("powers", _powers)
    ends: list[int] = []
    for at in range(0, n, len(power) - WINDOW):  # long documents in parts that overlap by a window
        start = max(0, at - WINDOW)
        x = ids[start : at + len(power) - WINDOW].astype(np.uint64)
        x += np.uint64(1)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        m = len(x)
        x *= inverse[:m]
        np.cumsum(x, out=x)
        x[WINDOW:] -= x[:-WINDOW].copy()
        x *= power[:m]
        places = np.flatnonzero(x < np.uint64(1 << (64 - MEAN_BITS))) + start + 1
        ends += places[places > at].tolist()
    out, last = [], 0
    for e in [*ends, n]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST and e < n:
            out.append(e)
            last = e
    return [*out, n] if not out or out[-1] < n else out


def pack(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def address(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up as it is."""
    level = leaves or [address(b"")]
    while len(level) > 1:
        level = [address(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return address(b"root" + level[0])


_X = 0xEDB88320  # the CRC-32 polynomial, bits reversed


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of pairs of polynomials modulo the CRC's, bits reversed (bit 31 is x**0)."""
    a, b = np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)
    out = np.zeros(np.broadcast(a, b).shape, dtype=np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(_X), np.uint32(0))
    return out


def shifted(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Each crc32 times x**(8 * bytes that come after): what its part adds to the crc32 of the whole.

    crc(a + b) = crc(a) * x**(8 |b|) + crc(b), so a whole's checksum is the sum (xor) over its parts.
    """
    different, place = np.unique(np.asarray(after, dtype=np.int64), return_inverse=True)
    power = np.full(len(different), 1 << 31, dtype=np.uint32)
    square, left = np.uint32(1 << 23), different.copy()  # x**8
    while left.any():
        odd = (left & 1).astype(bool)
        power[odd] = _times(power[odd], square)
        square, left = _times(square, square)[()], left >> 1
    return _times(power[place], crcs)


class TokenStore:
    """The three tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> TokenStore:
        """Encodes whole texts (null: empty, so just the end id) and writes the store.

        Rows of equal ids are kept, ordered by their roots; an id of null comes first. One pass
        encodes and one shuffle brings equal chunks together; a task sends a chunk once, so a
        chunk that many documents share arrives once a task.
        """
        spark = docs.sparkSession
        bounded_batches(spark)
        path = path or f"{shared_dir(spark)}/store-{os.urandom(6).hex()}"
        tokenizer = tokenizer or default_tokenizer()
        names = ["kind", "key", "data", "doc_id", "n_tokens", "recipe"]

        def encode(batches):
            encoder, sent = per_worker(tokenizer, lambda: Encoder(tokenizer)), set()
            for batch in _larger(batches):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0), encoder.ids(batch.column(1)), strict=True):
                    own, start = [], 0
                    for end in cuts(ids):
                        data = pack(ids[start:end])
                        own.append(address(data))
                        start = end
                        if own[-1] not in sent:
                            sent.add(own[-1])
                            rows.append(("chunk", own[-1], data, None, None, None))
                    root = merkle(own)
                    rows.append(("recipe", address(root + str(doc).encode()), root, doc.as_py(), len(ids), own))
                if len(sent) > CACHE:
                    sent.clear()
                types = [pa.string(), pa.binary(), pa.binary(), batch.schema.types[0], pa.int64(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

        def once(batches):
            """Rows come sorted by kind and key: a chunk that equals its neighbour before is a copy."""
            last = None
            for batch in batches:
                if not len(batch):
                    continue
                kind, key = batch.column(0), batch.column(1)
                before = pa.concat_arrays([pa.array([last], pa.binary()), key.slice(0, len(key) - 1)])
                last = key[-1].as_py()
                yield batch.filter(pc.or_(pc.equal(kind, "recipe"), pc.fill_null(pc.not_equal(key, before), True)))

        doc_type = docs.schema["doc_id"].dataType.simpleString()
        schema = f"kind string, key binary, data binary, doc_id {doc_type}, n_tokens long, recipe array<binary>"
        rows = docs.select("doc_id", "text").mapInArrow(encode, schema).repartition("key").sortWithinPartitions("kind", "key").mapInArrow(once, schema)
        rows.write.partitionBy("kind").parquet(f"{path}/parts")
        parts = spark.read.schema(schema).parquet(f"{path}/parts")
        recipes = parts.where("kind = 'recipe'").select("doc_id", F.col("data").alias("root"), "n_tokens", "recipe")
        ordered = with_prefix_sum(recipes, ["doc_id", "root"], "n_tokens", "start", "recipes", range_as="range")
        # ranges were dealt to tasks by hash for the sums: files in ascending order need ranges dealt in order
        ordered.df.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").write.parquet(f"{path}/recipes")
        ordered.drop()
        delete(spark, f"{path}/parts/kind=recipe")
        store = TokenStore(spark, path)
        store.leaves().write.parquet(f"{path}/manifest")
        return store

    def recipes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/recipes")

    def chunks(self) -> DataFrame:
        parts = self.spark.read.schema("kind string, key binary, data binary").parquet(f"{self.path}/parts")
        return parts.where("kind = 'chunk'").select(F.col("key").alias("chunk"), "data")

    def leaves(self) -> DataFrame:
        """level, range, block, hash, documents: of each block of ``LEAF`` recipe rows, of each range, of the store.

        A block's hash binds its rows' doc_id, start, number of ids and root, in order; a range's
        its blocks' hashes; the store's its ranges' hashes (as many as there are ranges).
        """
        order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "root")
        row = F.sha2(F.to_json(F.struct(F.col("doc_id").cast("string").alias("d"), "start", "n_tokens", F.hex("root").alias("r"))), 256)
        numbered = self.recipes().select("range", row.alias("hash"), F.row_number().over(order).alias("n"))
        numbered = numbered.withColumns({"block": F.floor((F.col("n") - 1) / LEAF), "documents": F.lit(1).cast("long")})

        def over(rows: DataFrame, level: str, place: str, keys: list[str]) -> DataFrame:
            told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, "hash"))), lambda x: x["hash"]), "")
            return rows.groupBy(*keys).agg(F.sha2(told, 256).alias("hash"), F.sum("documents").alias("documents")).withColumn("level", F.lit(level))

        blocks = over(numbered, "block", "n", ["range", "block"])
        ranges = over(blocks, "range", "block", ["range"])
        whole = over(ranges, "store", "range", [])
        return blocks.unionByName(ranges, allowMissingColumns=True).unionByName(whole, allowMissingColumns=True)

    def verify(self) -> None:
        """Raises if the recipes are not those of the manifest."""
        kept = self.spark.read.parquet(f"{self.path}/manifest")
        sides = kept.withColumn("side", F.lit(1)).unionByName(self.leaves().withColumn("side", F.lit(-1)))
        wrong = sides.groupBy("level", "range", "block", "hash", "documents").agg(F.sum("side").alias("n")).where("n <> 0").count()
        if wrong:
            raise ValueError(f"{wrong} blocks of the manifest do not match the recipes")

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

        Each chunk's hash is checked where it is read, each document's root against its recipe;
        checksums of chunks join to those of documents, so no ids move between machines.
        """
        self.verify()
        bounded_batches(self.spark)

        def measure(batches):
            for batch in batches:
                crcs, counts = [], []
                for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if address(data) != chunk:
                        raise ValueError(f"chunk {chunk.hex()} is damaged")
                    ids = unpack(data)
                    crcs.append(zlib.crc32(ids.tobytes()))
                    counts.append(len(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())], ["chunk", "crc", "n"])

        def rebuild(batches):
            for batch in batches:
                lists, roots = batch.column(1), batch.column(0).to_pylist()
                flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
                chunks, n = flat.field("chunk").to_pylist(), flat.field("n")
                if n.null_count:
                    raise ValueError(f"{n.null_count} chunks are missing")
                starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else np.empty(0, np.int64)
                for root, a, b in zip(roots, starts.tolist(), ends.tolist(), strict=True):
                    if merkle(chunks[a:b]) != root:
                        raise ValueError(f"document {root.hex()} does not match its root")
                total = np.cumsum(n.to_numpy())
                whole = np.repeat(total[ends - 1], ends - starts)
                crcs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(ends):
                    parts = shifted(flat.field("crc").to_numpy().astype(np.uint32), 4 * (whole - total))
                    crcs = np.bitwise_xor.reduceat(parts, starts).astype(np.int64)
                    counts = np.add.reduceat(n.to_numpy(), starts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())], ["root", "ids_crc32", "n_ids"])

        recipes = self.recipes()
        # copies share a root: each distinct document is put together once
        unique = recipes.select("root", "recipe").dropDuplicates(["root"])
        entries = unique.select("root", F.posexplode("recipe").alias("pos", "chunk"))
        measured = self.chunks().mapInArrow(measure, "chunk binary, crc long, n long")
        whole = entries.join(measured, "chunk", "left").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk", "crc", "n"))).alias("parts"))
        checked = Table(whole.mapInArrow(rebuild, "root binary, ids_crc32 long, n_ids long"), "rebuilt").df
        return recipes.select("doc_id", "start", "root").join(checked, "root").select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")

    def documents(self) -> DataFrame:
        """doc_id, start and the ids themselves, as an array, of every document."""
        entries = self.recipes().select("root", "recipe").dropDuplicates(["root"]).select("root", F.posexplode("recipe").alias("pos", "chunk"))
        whole = entries.join(self.chunks(), "chunk").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "data"))).alias("parts"))

        def rebuild(batches):
            for batch in batches:
                ids = [np.concatenate([unpack(p["data"]) for p in parts]).astype(np.int32) for parts in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["root", "ids"])

        return self.recipes().select("doc_id", "start", "root").join(whole.mapInArrow(rebuild, "root binary, ids array<int>"), "root").drop("root")

    def drop(self) -> None:
        delete(self.spark, self.path)


def op6_token_store(spark, sf_dir) -> DataFrame:
    return TokenStore.write(spark.read.parquet(f"{sf_dir}/documents.parquet")).read()
