"""Phrase collocations, counted over a prefix-free parse of the corpus.

A text is lower-cased (A-Z) and cut at punctuation and line ends into pieces,
a piece into words. A piece is parsed into chunks: a chunk ends where a window
of ``longest - 1`` words hashes to a trigger value, and the next one begins
with that window. So the same passage gives the same chunks wherever it stands,
and copies of it are one row of the dictionary with a parse frequency. Each
phrase of up to ``longest`` words lies wholly in the chunk that owns its first
word: all words but those of the window shared with the next chunk. So counts
over distinct chunks, weighted with their frequencies, are the exact counts.

Phrases that may be frequent are found length by length, by 64-bit hashes: one
of n words can reach ``least`` occurrences only if both of its parts of n - 1
words do; those are sent to the tasks as a bitmap, at most 32 MB at any corpus
size. What is left is counted as text. Equal hashes, and a full bitmap, let
more phrases through to that count and never change one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshelf.llm.common import raw
from vecshelf.session import written

#: All characters at which a text is cut into pieces become line feeds.
CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d", b"\n" * 9)
#: A window is a trigger if its hash is divisible by this; a chunk owns so many words at least.
TRIGGER, SHORTEST_CHUNK = 8, 8
#: A chunk without a trigger ends after so many words, so that a piece of one
#: endlessly repeated word gives small chunks as well.
LONGEST_CHUNK = 256
#: Rows and bytes a task holds before it hands its partial counts on.
HELD, HELD_BYTES = 400_000, 48 << 20
#: Hashes a task holds before it adds them up, and bytes of chunks looked at a time.
HASHES, SLICE = 4_000_000, 2 << 20
#: Bits of a bitmap for each phrase, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_RNG = np.random.default_rng(11)
_TABLES = _RNG.integers(0, 1 << 63, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_M, _N = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x165667B19E3779F9)


def chunks_of(
    words: list[bytes], overlap: int, trigger: int = TRIGGER, least: int = SHORTEST_CHUNK, most: int = LONGEST_CHUNK
) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, last) of the chunks of a piece; neighbours share ``overlap`` words."""
    begin, n = 0, len(words)
    end = begin + least + overlap
    while end < n:
        if end - begin >= most + overlap or crc32(b" ".join(words[end - overlap : end])) % trigger == 0:
            yield begin, end, False
            begin = end - overlap
            end = begin + least + overlap
        else:
            end += 1
    if begin < n:
        yield begin, n, True


def _parse(overlap: int):
    """(lang, chunk, last, n) of texts, added up for as many as a task may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, dict]] = {}
        rows = size = 0
        short = SHORTEST_CHUNK + overlap

        def out() -> Iterator[pa.RecordBatch]:
            for lang, tables in held.items():
                for last, table in zip((False, True), tables, strict=True):
                    chunks = pa.array(list(table), pa.binary()).cast(pa.string())
                    same = [pa.array([v], t).take(pa.array(np.zeros(len(table), np.int32))) for v, t in ((lang, pa.string()), (last, pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([same[0], chunks, same[1], pa.array(table.values(), pa.int64())], ["lang", "chunk", "last", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                inner, whole = held.setdefault(lang, ({}, {}))
                before = len(inner) + len(whole)
                for piece in text.lower().translate(CUTS).split(b"\n"):
                    words = piece.split()
                    if len(words) <= short:
                        if words:
                            chunk = b" ".join(words) + b"\n"
                            whole[chunk] = whole.get(chunk, 0) + 1
                        continue
                    for begin, end, last in chunks_of(words, overlap):
                        chunk, table = b" ".join(words[begin:end]) + b"\n", whole if last else inner
                        table[chunk] = table.get(chunk, 0) + 1
                rows += len(inner) + len(whole) - before
                size += len(text)
                if rows >= HELD or size >= HELD_BYTES:
                    yield from out()
                    held.clear()
                    rows = size = 0
        yield from out()

    return run


def dictionary(docs: DataFrame, longest: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of the parse and how often
    each occurs. A space stands between the words of a chunk and a line feed at
    its end. ``last`` chunks end their piece and own all of their words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    parsed = rows.mapInArrow(_parse(longest - 1), "lang string, chunk string, last boolean, n long")
    return parsed.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64."""
    found = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        found.append(np.multiply.accumulate(x))
    return found[0], found[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some chunks, hashed in numpy."""

    _known: dict[int, list] = {}

    def __init__(self, rows: pa.Table, overlap: int, hashes: int = 1) -> None:
        lang = rows["lang"].combine_chunks().dictionary_encode()
        self.langs, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        # the chunks lie one behind the other, each with its line feed
        chunks = rows["chunk"].combine_chunks().cast(pa.binary())
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
        flat = np.frombuffer(chunks.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        self.data = memoryview(flat)
        ends = np.flatnonzero((flat == 10) | (flat == 32))
        starts = np.concatenate(([0], ends[:-1] + 1))
        counts = np.diff(np.searchsorted(ends, offsets - offsets[0]))
        self.starts, self.ends = starts, ends
        chunk = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.left = counts[chunk] - place  # words from this one to the chunk's end
        self.owned = rows["last"].to_numpy()[chunk] | (self.left > overlap)
        self.weight = rows["n"].to_numpy()[chunk]
        self.lang = codes[chunk]
        seed = np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in self.langs], np.uint64)[self.lang]
        long = np.flatnonzero(ends - starts > LONG_WORD).tolist()
        self.hashes = []
        for k in range(hashes):
            up, down = self._powers(len(flat), k)
            sums = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(_TABLES[k][flat] * up[: len(flat)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts]
            for i in long:
                h[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]], 21 + k)
            self.hashes.append(_mixed(h + seed))

    @classmethod
    def _powers(cls, n: int, k: int) -> list:
        # a worker keeps the powers for one slice
        if k not in cls._known or len(cls._known[k][0]) < n:
            cls._known[k] = _powers(max(n, 2 * SLICE), _BASES[k])
        return cls._known[k]

    def phrases(self, n: int, k: int = 0) -> np.ndarray:
        """Hashes of the phrases of ``n`` words from each word on; those that
        reach beyond the data's end are cut off."""
        h = self.hashes[k]
        size = max(0, len(h) - n + 1)
        g = h[:size]
        for i in range(1, n):
            g = _mixed(g * _N + h[i : i + size])
        return g

    def fits(self, n: int) -> np.ndarray:
        return self.left[: max(0, len(self.left) - n + 1)] >= n


def _slices(batches: Iterator[pa.RecordBatch], overlap: int, hashes: int = 1) -> Iterator[Words]:
    """The rows of (lang, chunk, last, n), so many at a time as make a slice."""
    held, size = [], 0
    for batch in chain(batches, [None]):
        if held and (batch is None or size + batch.nbytes > SLICE):
            yield Words(pa.Table.from_batches(held), overlap, hashes)
            held, size = [], 0
        if batch is not None and batch.num_rows:
            held.append(batch)
            size += batch.nbytes


def _marked(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(field) - 1)
    return (field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _hashed(n: int, overlap: int, sent):
    """(hash, n): how often phrases of ``n`` words occur whose parts are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.frombuffer(sent.value, np.uint8) if n > 1 else None
        held, size = [], 0

        def out() -> pa.RecordBatch:
            hashes, weights = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            sums = np.add.reduceat(weights[order], first)
            return pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(sums)], ["hash", "n"])

        for words in _slices(batches, overlap):
            good = words.fits(n) & words.owned[: len(words.owned) - n + 1] if len(words.owned) >= n else np.zeros(0, bool)
            if n > 1 and len(good):
                part = _marked(field, words.phrases(n - 1))
                good &= part[:-1] & part[1:]
            if good.any():
                held.append((words.phrases(n)[good], words.weight[: len(good)][good]))
                size += len(held[-1][0])
            if size >= HASHES:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """Bits set at the hashes; built by Spark in blocks of 4 KB."""
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    blocks = hashes.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    found = bytearray(max(bits // 8, 4096))
    for row in blocks.toLocalIterator():
        found[row["block"] * 4096 : (row["block"] + 1) * 4096] = row["bits"]
    return bytes(found)


def _texts(longest: int, overlap: int, sent):
    """(lang, phrase, words, a): partial counts of all phrases that are marked;
    under no words, how many words there are. Phrases are told apart by 128 bits
    of hash within a slice, and as texts beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [np.frombuffer(f, np.uint8) for f in sent.value]
        held: dict[tuple, int] = {}
        totals: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            langs, words, phrases = zip(*held, strict=True)
            columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(words, pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(held.values(), pa.int64())], ["lang", "phrase", "words", "a"])

        for words in _slices(batches, overlap, 2):
            own = np.bincount(words.lang, words.weight * words.owned, len(words.langs)).astype(np.int64)
            for lang, x in zip(words.langs, own.tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + x
            for n in range(1, min(longest, len(words.owned)) + 1):
                h = words.phrases(n)
                at = np.flatnonzero(words.fits(n) & words.owned[: len(h)] & _marked(fields[n - 1], h))
                if not len(at):
                    break
                h, g = h[at], words.phrases(n, 1)[at]
                order = np.lexsort((g, h))
                h, g, at = h[order], g[order], at[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
                sums = np.add.reduceat(words.weight[at], first).tolist()
                at = at[first]
                places = zip(words.lang[at].tolist(), words.starts[at].tolist(), words.ends[at + n - 1].tolist(), sums, strict=True)
                for code, a, b, x in places:
                    key = (words.langs[code], n, bytes(words.data[a:b]))
                    held[key] = held.get(key, 0) + x
            if len(held) >= HELD:
                yield out()
                held = {}
        held |= {(lang, 0, b""): x for lang, x in totals.items()}
        if held:
            yield out()

    return run


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, a): every phrase of 1 to ``longest`` words that
    occurs ``least`` times or more in its language, with its count; a row with
    ``words`` 0 holds the count of all words."""
    context, overlap = docs.sparkSession.sparkContext, longest - 1
    chunks = written(dictionary(docs, longest, text, lang), "chunks")
    fields, sent = [], None
    for n in range(1, longest + 1):
        counted = chunks.mapInArrow(_hashed(n, overlap, sent), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        found = written(counted.where(F.col("n") >= least).select("hash"), "hashes")
        total = found.count()
        bits = max(1 << 15, min(MOST_BITS, 1 << (BITS_EACH * max(total, 1) - 1).bit_length()))
        fields.append(bitmap(found, bits))
        sent = context.broadcast(fields[-1])
    every = context.broadcast(fields)
    counted = chunks.mapInArrow(_texts(longest, overlap, every), "lang string, phrase string, words int, a long")
    found = counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    return written(found.where((F.col("a") >= least) | (F.col("words") == 0)), "phrases")


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, inside: int = 80, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of 2 to
    ``longest`` words of each language.

    ``score`` is floor(2000000 * a / (l + r)) of the phrase's worst cut; ``l``
    and ``r`` are the counts of the parts. A phrase goes if a longer one that
    holds its words side by side has at least ``inside`` percent of its count.

    A NULL language is ``und``. NULL and empty texts, and texts of punctuation,
    have no words; a table without words gives no rows. Repeated rows count
    each time. Other columns are not read. Ties: by count, then by phrase in
    byte order. All counts are exact; only the report has a limit, ``top``.
    """
    phrases = frequent_phrases(docs, least, longest, text, lang)
    totals = phrases.where("words = 0").select("lang", F.col("a").alias("n"))
    counts = phrases.where("words > 0")
    candidates = counts.where("words > 1").withColumn("w", F.split("phrase", " "))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("first"),
        F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("words"))).alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000bd div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    worst = worst.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    longer = candidates.where("words > 2").select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    longer = longer.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    longer = longer.select("lang", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("m"))).alias("phrase"), F.col("a").alias("holder"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("holder").alias("holder"))

    kept = worst.join(longer, ["lang", "phrase"], "left")
    swallowed = F.lit(100).cast("decimal(20,0)") * F.col("holder") >= F.lit(inside).cast("decimal(20,0)") * F.col("a")
    kept = kept.where(F.col("holder").isNull() | ~swallowed).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    ranked = kept.withColumn("rank", order.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with src as (
  select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) p from src),
w as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') ws from pieces),
grams as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) phrase
  from (select lang, ws, unnest(range(1, least(len(ws), 4) + 1)) k from w)),
f as materialized (select lang, k, phrase, count(*) a from grams group by all),
n as (select lang, sum(a)::bigint n from f where k = 1 group by lang),
cand as (select lang, k, phrase, a, string_split(phrase, ' ') ws from f where k > 1 and a >= 30),
parts as materialized (
  select lang, phrase, a, j cut, array_to_string(ws[1 : j], ' ') head, array_to_string(ws[j + 1 : k], ' ') rest
  from (select *, unnest(range(1, k)) j from cand)),
lefts as materialized (select p.*, x.a l from parts p join f x on x.lang = p.lang and x.phrase = p.head),
cuts as materialized (
  select p.lang, p.phrase, p.a, p.cut, p.l, y.a r, (2000000::hugeint * p.a) // (p.l::hugeint + y.a) score
  from lefts p join f y on y.lang = p.lang and y.phrase = p.rest),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
subs as (
  select lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) phrase
  from (select *, unnest(range(2, k)) m from cand)),
holder as (select lang, phrase, max(a) a from subs group by all),
kept as (
  select w.* from worst w left join holder h on h.lang = w.lang and h.phrase = w.phrase
  where h.a is null or 100::hugeint * h.a < 80::hugeint * w.a)
select lang, rank, phrase, a, l, r, n, score::bigint score from (
  select k.*, n.n, row_number() over (partition by k.lang order by score desc, a desc, phrase) rank from kept k join n on n.lang = k.lang)
where rank <= 2000
"""
