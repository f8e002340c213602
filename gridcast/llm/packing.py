"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import bucket, bucket_offsets, buckets_of, text_of
from gridcast.session import settle

CAPACITY = 2048
END_ID = 0
# Words remembered by a Python worker, in two generations; a forgotten word is encoded again.
REMEMBERED = 800_000
# A full stop or comma that follows a letter and ends a word is a token of its own, so it is split off before words are looked up.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=\s|$)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([.,])(?=\s|$)")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, for a tokenizer whose tokens never span white space.

    Each different word goes through the tokenizer once and is then looked up. ASCII letters are lowered first, as the
    tokenizer does itself. Texts in which that is not the same go through it whole: those with the opening of a special token, which is
    matched before letters are lowered, and those with combining marks, which some lower letters take and their capitals do not.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The byte alphabet: printable signs of Latin-1 stand for themselves, the other bytes for the signs from 256 on, in order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in printable)
        self.signs = {b: 256 + k for k, b in enumerate(others)}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        # A word of letters is one unit of the tokenizer. Composed and in lower case it goes to the model itself, each byte as its sign in the
        # tokenizer's byte alphabet; all other words take the tokenizer's whole way.
        model, rest = self.tokenizer.model, []
        for w in words:
            if w.isalpha():  # ASCII letters only, as w is bytes
                ids = [t.id for t in model.tokenize(w.decode())]
            elif (s := w.decode()).isalpha() and s.islower() and is_normalized("NFC", s):
                ids = [t.id for t in model.tokenize(w.decode("latin-1").translate(self.signs))]
            else:
                rest.append(w)
                continue
            self.young[w] = array("I", ids).tobytes()
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for w, e in zip(rest, encode([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self.young[w] = array("I", e.ids).tobytes()

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw:  # the two bytes begin U+0300 to U+037F
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = _STOP.sub(rb" \1\2", raw.lower()).split()
        young = self.young
        try:
            return b"".join([young[w] for w in words])
        except KeyError:
            missing = []
            for w in set(words).difference(young):
                if w in self.old:
                    young[w] = self.old[w]
                else:
                    missing.append(w)
            self._learn(missing)
            young = self.young
            if len(young) > REMEMBERED // 2:
                self.old, self.young = young, {}
            return b"".join([young[w] for w in words])


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids``: every document's ids and a closing 0, cut only where longer than ``capacity``."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encoder(path).encode(t) for t in part.column("text").to_pylist()]
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
                for doc_id, own in zip(part.column("doc_id"), ids, strict=True):
                    own += END_ID.to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[at : at + 4 * capacity]
                        for name, value in zip(out, (doc_id.as_py(), k, at // 4, len(piece) // 4, piece), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([
        ("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("piece", pa.int32()),
        ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ])
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest lengths first, over counts: ``length, first, last, sequence, per, offset`` rows.

    Pieces of a length with ranks first <= r < last lie ``per`` to a sequence, in sequences numbered from
    ``sequence`` on, from place ``offset`` on. Sequences with equal room are kept as ranges, so the work depends on the number of
    lengths, never on the number of pieces.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = {}  # free places -> ranges [from, to) of sequences
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fit = min((r for r in room if r >= length), default=capacity)
            if fit not in room:
                room.setdefault(fit, []).append([sequences, sequences + -(-left // (capacity // length))])
                sequences = room[fit][-1][1]
            per = fit // length
            ranges = room[fit]
            lo, hi = ranges[-1]
            full = min(hi - lo, left // per)
            if full:  # sequences that take as many of this length as go in
                slots.append((length, rank, rank + full * per, lo, per, capacity - fit))
                rest, count, used = fit - per * length, full, full * per
            else:  # one last sequence takes what is left
                slots.append((length, rank, rank + left, lo, left, capacity - fit))
                rest, count, used = fit - left * length, 1, left
            left, rank = left - used, rank + used
            if lo + count == hi:
                ranges.pop()
                if not ranges:
                    del room[fit]
            else:
                ranges[-1][0] = lo + count
            if rest:
                near = room.setdefault(rest, [])
                if near and near[-1][1] == lo:
                    near[-1][1] = lo + count
                else:
                    near.append([lo, lo + count])
    return slots


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with ``sequence_id`` and ``offset`` of each.

    The driver holds the histogram, at most ``capacity`` counts. Each length's pieces are ranked over buckets of a hash
    of their document, and take the planned slot of their rank; a length that holds most pieces is ranked by
    many tasks.
    """
    spark = pieces.sparkSession
    extra = [c for c in pieces.columns if c != "length"]
    rows = pieces.select("length", F.struct(*[f"`{c}`" for c in extra]).alias("_row"), F.col("doc_id").alias("_id"), F.col("piece").alias("_piece"))
    rows = rows.withColumn("_bucket", bucket(["_id", "_piece"], buckets_of(spark)))
    dealt = settle(bucket_offsets(rows, ["length"]))
    histogram = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity) or [(0, 0, 0, 0, 1, 0)],
        "length bigint, first bigint, last bigint, sequence bigint, per bigint, from bigint",
    )
    # Which slots the ranks of a bucket meet is settled on the small tables; the rows then join once.
    met = dealt.join(slots, "length").where("first < _before + _n and last > _before")
    spans = met.groupBy(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), "_before").agg(
        F.collect_list(F.struct("first", "last", "sequence", "per", "from")).alias("_slots")
    )
    at = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_id", "_piece")) - 1
    ranked = rows.withColumn("_at", at)
    spans = spans.select(F.col("_l").alias("length"), F.col("_b").alias("_bucket"), "_before", "_slots")
    rank = F.col("_before") + F.col("_at")
    slot = F.element_at(F.filter("_slots", lambda s: (s["first"] <= rank) & (rank < s["last"])), 1)
    placed = ranked.join(spans, ["length", "_bucket"]).select("length", "_row", rank.alias("_rank"), slot.alias("_s"))
    step = F.col("_rank") - F.col("_s.first")
    return placed.select(
        *[F.col(f"_row.`{c}`").alias(c) if c != "length" else F.col("length") for c in pieces.columns],
        (F.col("_s.sequence") + F.floor(step / F.col("_s.per"))).alias("sequence_id"),
        (F.col("_s.from") + step % F.col("_s.per") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs(doc_id, text, ...)`` with their ids and places: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    A null or empty text is one piece that holds the closing id alone. Only documents longer than ``capacity`` are cut.
    Rows that repeat a doc_id, or have a null one, are packed each; an empty table packs nothing. Other columns are ignored.
    """
    return place(settle(tokenise(docs, path, capacity)), capacity)


def pack_digest(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` with the ids' CRC-32 in their place, taken before anything is stored or moved."""
    pieces = tokenise(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(settle(pieces), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_pieces, ids``: the ids of every sequence, its pieces in order of place (at most ``capacity`` ids)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.size("_p").alias("n_pieces"), F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
