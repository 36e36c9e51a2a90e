"""Phrase collocation mining.

1. Texts are split into pieces, and identical pieces of a language become one with a
   multiplicity, so repeated lines are worked on once.
2. Words are counted.  A set of 2^23 bits, one MB whatever the input, names those that
   may reach the threshold; phrases with another word can't.
3. Each position of a piece gives its pair of words, equal ones of a task already added
   up.  They are shuffled into hash buckets, and DuckDB counts a bucket's phrases within
   a fixed memory, spilling to the executor's disk.  A second set of bits names the
   frequent pairs; each position that goes on with such pairs gives its window of three
   to five words.  Those are shuffled by their first three words and counted likewise:
   threes, then the fours that begin with a frequent three, then the fives.  The
   sets only spare work; where they are full, each position still gives one row a round.
4. Phrases and their parts lie in different buckets.  Each phrase sends a request for
   each part of each of its cuts, shuffled to where the part's count is, and the
   answers come back by phrase.  A phrase lies in a longer one of the same count only if
   it does so in one with one word more, so the same requests find those to be dropped.

Counts are exact, and the scores are integer arithmetic of 38 digits.  A pair that is
everywhere is one row a task and not a hot bucket; so is a passage that many texts share.

Defined results: null and empty texts have no pieces; a null language is ``und``; long
texts count whole; repeated rows count again; keys aren't read; ties go by count, then
by the phrase's bytes; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import string
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete_path, scratch_path
from .exact_dedup import _disk

#: What ends a piece.
BREAK = r"[.,;:!?\x0A-\x0D]"
LONGEST = 5
FILTER_BITS = 23
#: Bytes of pieces whose phrases a task adds up at a time, and what DuckDB may take.
CHUNK_BYTES, MEMORY = 8 << 20, "192MB"
#: Languages up to which their totals are broadcast.
MOST_BROADCAST = 10_000
COUNTS = "lang string, words int, phrase string, f long"
_MASK = (1 << FILTER_BITS) - 1


def pieces(documents: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces with words, joined by one space, and how
    often each occurs."""
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase + "\t", string.ascii_lowercase + " ")
    each = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(low, BREAK)).alias("piece"))
    plain = each.withColumn("piece", F.trim(F.when(F.contains("piece", F.lit("  ")), F.regexp_replace("piece", " +", " ")).otherwise(F.col("piece"))))
    return plain.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _word_hash(word: str) -> str:
    return f"xxhash64(concat(lang, ' ', {word}))"


def _pair_hash(first, second):
    """The hash of a pair from its words' hashes, in NumPy as in SQL."""
    if isinstance(first, str):
        return f"({first} ^ shiftleft({second}, 1) ^ shiftrightunsigned({second}, 20))"
    return first ^ (second << np.uint64(1)) ^ (second >> np.uint64(20))


def _bits(rows: DataFrame, hashed: str) -> np.ndarray:
    """A set bit for each slot that a row hashes to."""
    slots = rows.select(F.expr(f"{hashed} & {_MASK}L").alias("s"))
    words = slots.groupBy(F.shiftright("s", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).collect()  # 2^18 rows at most
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for at, word in words:
        bits[at] = word
    return bits


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes & np.uint64(_MASK)).astype(np.int64)
    return ((bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1).astype(bool)


def _summed(columns: list[np.ndarray], m: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of codes as one, with their m added up."""
    names = [str(i) for i in range(len(columns))]
    t = pa.table([*columns, m], names=[*names, "m"]).group_by(names, use_threads=False).aggregate([("m", "sum")])
    return [t[n].to_numpy() for n in names], t["m_sum"].to_numpy()


def _grams_of(lang: str, texts: pa.Array, m: np.ndarray, bits: list[np.ndarray]) -> pa.RecordBatch | None:
    """The pairs of frequent words, or, with the bits of pairs too, the windows of
    three words or more that go on with frequent pairs."""
    import xxhash

    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
    hashes = np.array([xxhash.xxh64_intdigest(f"{lang} {w}".encode(), 42) for w in words.to_pylist()], np.uint64)
    frequent = _has(bits[0], hashes)[codes]
    sizes = pc.list_value_length(lists).to_numpy()
    end, m = np.repeat(np.cumsum(sizes), sizes), np.repeat(m, sizes)
    at = np.arange(len(codes))
    pair = np.zeros(len(codes), bool)
    pair[:-1] = frequent[:-1] & frequent[1:] & (at[:-1] + 1 < end[:-1])
    size, reach = 2, 2
    long = 2 * pair
    if len(bits) > 1:
        size, reach = 3, LONGEST
        here = np.flatnonzero(pair)
        pair[here] = _has(bits[1], _pair_hash(hashes[codes[here]], hashes[codes[here + 1]]))
        long, whole = pair + 1, pair.copy()
        for k in range(1, LONGEST - 1):
            whole[:-k] &= pair[k:]
            whole[-k:] = False
            long = long + whole
    here = np.flatnonzero(long >= size)
    if not len(here):
        return None
    columns = [codes[here + k] if k < size else np.where(long[here] > k, codes[np.minimum(here + k, len(codes) - 1)], -1) for k in range(reach)]
    columns, total = _summed(columns, m[here])
    word = lambda c: pc.take(words, pa.array(c, mask=c < 0))
    head = pc.binary_join_element_wise(*[word(c) for c in columns[:size]], " ")
    rest = [word(c) for c in columns[size:]]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), head, *rest, pa.array(total, pa.int64())], names=["lang", "head", "fourth", "fifth"][: 2 + len(rest)] + ["m"])


def _grams(bits: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            for lang in pc.unique(t["lang"]).to_pylist():
                own = t.filter(pc.equal(t["lang"], lang))
                found = _grams_of(lang, own["piece"].combine_chunks(), own["m"].to_numpy(), bits)
                if found is not None:
                    yield found

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= CHUNK_BYTES:
                yield from flush()
        if held:
            yield from flush()

    return run


def _counted(columns: str, steps: list[str], result: str, memory: str):
    """A bucket's rows as DuckDB's table g (columns), the steps, and the result's rows;
    DuckDB spills beyond its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory(prefix="grams-", dir=_disk()) as folder, duckdb.connect(config={"memory_limit": memory, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False}) as db:
            db.execute(f"CREATE TABLE g({columns})")
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                db.execute("INSERT INTO g SELECT * FROM batch")
                db.unregister("batch")
            for step in steps:
                db.execute(step)
            yield from db.sql(result).to_arrow_table().to_batches(max_chunksize=100_000)

    return run


def _count_pairs(least: int, memory: str):
    return _counted("lang VARCHAR, head VARCHAR, m BIGINT", [], f"SELECT lang, 2 AS words, head AS phrase, CAST(sum(m) AS BIGINT) AS f FROM g GROUP BY ALL HAVING sum(m) >= {least}", memory)


def _count_longer(least: int, memory: str):
    frequent = f"HAVING sum(m) >= {least}"
    steps = [
        f"CREATE TABLE threes AS SELECT lang, head, CAST(sum(m) AS BIGINT) AS f FROM g GROUP BY ALL {frequent}",
        "CREATE TABLE longer AS SELECT * FROM g SEMI JOIN threes USING (lang, head) WHERE fourth IS NOT NULL",
        f"CREATE TABLE fours AS SELECT lang, head, fourth, CAST(sum(m) AS BIGINT) AS f FROM longer GROUP BY ALL {frequent}",
    ]
    result = f"""SELECT lang, 3 AS words, head AS phrase, f FROM threes UNION ALL SELECT lang, 4, head || ' ' || fourth, f FROM fours
        UNION ALL SELECT lang, 5, head || ' ' || fourth || ' ' || fifth, CAST(sum(m) AS BIGINT) FROM longer SEMI JOIN fours USING (lang, head, fourth) WHERE fifth IS NOT NULL GROUP BY lang, head, fourth, fifth {frequent}"""
    return _counted("lang VARCHAR, head VARCHAR, fourth VARCHAR, fifth VARCHAR, m BIGINT", steps, result, memory)


def phrase_counts(documents: DataFrame, least: int = 100, memory: str = MEMORY) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to 5 words with the least count,
    and (lang, n)."""
    spark = documents.sparkSession
    folder = scratch_path(spark, "pieces")
    pieces(documents).write.parquet(f"{folder}/pieces")
    distinct = spark.read.parquet(f"{folder}/pieces")
    distinct.select("lang", "m", F.explode(F.split("piece", " ")).alias("word")).groupBy("lang", "word").agg(F.sum("m").alias("f")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    totals = cut(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = words.where(F.col("f") >= least)
    word_bits = _bits(frequent, _word_hash("word"))
    several = distinct.where(F.contains("piece", F.lit(" ")))
    pairs = cut(several.mapInArrow(_grams([word_bits]), "lang string, head string, m long").repartition("lang", "head").mapInArrow(_count_pairs(least, memory), COUNTS))
    first, second = (_word_hash(f"split(phrase, ' ')[{i}]") for i in (0, 1))
    pair_bits = _bits(pairs, _pair_hash(first, second))
    windows = several.mapInArrow(_grams([word_bits, pair_bits]), "lang string, head string, fourth string, fifth string, m long")
    counted = pairs.unionByName(windows.repartition("lang", "head").mapInArrow(_count_longer(least, memory), COUNTS))
    single = frequent.select("lang", F.lit(1).alias("words"), F.col("word").alias("phrase"), "f")
    counts = cut(single.unionByName(counted))
    delete_path(spark, folder)
    return counts, totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more that lie in
    no longer one of the same count, by their lowest-scoring cut."""
    candidates = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(word, start, n), " ")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    requests = cuts.select("lang", "phrase", "words", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "words", "a", "k", "s.left", "s.part")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    # few languages go to every task; should there be many, none is hot
    totals = F.broadcast(totals) if totals.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else totals
    sided = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top = F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")
    ratio = sided.select("*", top.alias("top"), (wide("l") * wide("r")).alias("bottom")).withColumn("score", F.expr("top div bottom"))
    best = ratio.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inside = requests.where((F.col("left") & (F.col("k") == F.col("words") - 1)) | (~F.col("left") & (F.col("k") == 1))).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    return kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def collocations(documents: DataFrame, least: int = 100, first: int = 2000, memory: str = MEMORY) -> DataFrame:
    """Each language's first phrases by score, with rank."""
    found = scored(*phrase_counts(documents, least, memory))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def op13(documents: DataFrame) -> DataFrame:
    return collocations(documents)
