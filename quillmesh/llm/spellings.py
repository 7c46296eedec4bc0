"""Spelling variants: word counts with seeded slips, single edits by dense prefix-suffix tiles, forms and roots."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common

#: Bytes of Latin-1 that are letters of a run (A-Z in lower case), all others blanks.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_HELD = 200_000  # distinct words that a task counts before it hands them on
_BLOCK = 1024  # words of one key that are a block
_TILE = 256  # rows of a tile, which small blocks share
_WIDTH = 64  # code points that are laid out at once; longer words go on in further columns


def runs(text: str) -> list[bytes]:
    """The maximal runs [A-Za-z\\u00C0-\\u00FF]+ of a text with A-Z in lower case, in UTF-8."""
    return text.encode("latin-1", "replace").translate(_RUNS).decode("latin-1").encode().split()


def slipped(run: bytes, h: int) -> bytes:
    """A run without its code point h % length."""
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def word_counts(docs: DataFrame, one_in: int = 199, least_chars: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of docs(doc_id, text): runs with A-Z in lower case; where one_in divides the crc32 of "<doc_id>:<run>" a code
    point is left out. Words of at least so many code points and occurrences.

    Null texts have no runs; a null id counts as empty in the crc32. Tasks count up to 200,000 distinct words at a time, and
    those counts are what is shuffled.
    """

    def table(counts):
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for id_, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = [w for w in runs(text.as_py()) if len(w) >= least_chars]
                start = crc32(f"{'' if id_ is None else id_}:".encode())
                total.update(words)
                slips = [w for w in set(words) if crc32(w, start) % one_in == 0]
                if slips:
                    own = Counter(words)
                    for w in slips:
                        total[w] -= own[w]
                        total[slipped(w, crc32(w, start))] += own[w]
                if len(total) > _HELD:
                    yield table(total)
                    total.clear()
        yield table(total)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    counts = common.map_texts(texts, run, "word string, n long").where(F.length("word") >= least_chars)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keyed(words: DataFrame) -> DataFrame:
    """words(word, n) under the keys by which two words with one edit between them meet, once as the longer and once as the
    shorter of a pair.

    Of a pair whose longer word has L code points, the common prefix and suffix hold L - 1 at least, so one of them holds
    L div 2: the words share their first or their last L div 2 code points.
    """
    size = F.length("word")
    parts = []
    for longer, of in ((True, size), (False, size + 1)):
        half = F.floor(of / 2).cast("int")
        parts += [F.struct(F.lit(kind).alias("kind"), of.alias("of"), F.lit(longer).alias("longer"), F.concat(F.lit(f"{kind}:"), of.cast("string"), F.lit(":"), piece).alias("key")) for kind, piece in (("p", F.substring("word", F.lit(1), half)), ("s", F.substring("word", size - half + 1, half)))]
    return words.select("word", "n", F.explode(F.array(*parts)).alias("k")).select("word", "n", "k.kind", "k.of", "k.longer", "k.key")


def _codes(words: list[str], at: int, width: int) -> np.ndarray:
    """Code points of words from place `at` on, padded with 0, which no word has."""
    flat = "".join(w[at : at + width].ljust(width, "\0") for w in words)
    try:
        return np.frombuffer(flat.encode("latin-1"), np.uint8).reshape(len(words), width)
    except UnicodeEncodeError:
        return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def common_prefixes(words: list[str]) -> np.ndarray:
    """The length of the common prefix of each word with each, a dense matrix; of words spelled backwards, the common suffix."""
    longest = max(map(len, words))
    out = np.zeros((len(words), len(words)), np.uint8 if longest < 256 else np.int32)
    alive = np.ones(out.shape, bool)
    for at in range(0, longest, _WIDTH):
        columns = _codes(words, at, min(_WIDTH, longest - at)).T.copy()
        for column in columns:
            alive &= column[:, None] == column
            alive &= (column != 0)[:, None]
            if not alive.any():
                return out
            out += alive
    return out


def compare(words: list[str], of: np.ndarray, longer: np.ndarray, suffix: np.ndarray, tile: np.ndarray, mine: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Which rows, as pairs, are one edit apart and to be found here: rows of one tile and, unless the tile is one block
    alone, of different blocks; one of them of length `of`; and not those of suffix keys that a prefix key finds."""
    prefix = common_prefixes(words)
    both = prefix.astype(np.int32) + common_prefixes([w[::-1] for w in words])
    found = (both >= of[:, None] - 1) & (longer[:, None] | longer)
    found &= tile[:, None] == tile
    found &= alone[:, None] | (mine[:, None] != mine)
    found &= ~suffix[:, None] | (prefix < of[:, None] // 2)
    np.fill_diagonal(found, False)
    return found


def _tiles(batches):
    """Near words, counted by word, of rows sorted by tile; consecutive small tiles are compared as one."""
    names = ("tile", "word", "n", "of", "longer", "suffix", "mine", "alone")

    def whole(rows):
        order = sorted(range(len(rows["n"])), key=lambda i: (-rows["n"][i], rows["word"][i]))
        words = [rows["word"][i] for i in order]
        own = {c: np.array([rows[c][i] for i in order]) for c in names if c != "word"}
        found = compare(words, *(own[c] for c in names[3:6]), own["tile"], own["mine"], own["alone"])
        some = np.flatnonzero(found.any(axis=1))
        best = found[some].argmax(axis=1)  # the first: of largest n, then of smallest spelling
        return pa.RecordBatch.from_pydict({"word": pa.array([words[i] for i in some], pa.string()), "n_near": found[some].sum(axis=1, dtype=np.int64), "form": pa.array([words[i] for i in best], pa.string()), "form_n": own["n"][best].astype(np.int64)})

    held: dict[str, list] = {c: [] for c in names}
    for batch in batches:
        for c in names:
            held[c] += batch.column(c).to_pylist()
        tile = np.array(held["tile"], np.int64)
        ends = [*(np.flatnonzero(np.diff(tile)) + 1).tolist()]  # the last tile may go on in the next batch
        start = last = 0
        for end in ends:
            if end - start > _TILE and last > start:
                yield whole({c: x[start:last] for c, x in held.items()})
                start = last
            last = end
        if last > start:
            yield whole({c: x[start:last] for c, x in held.items()})
        held = {c: x[last:] for c, x in held.items()}
    if held["n"]:
        yield whole(held)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of words(word, n) that have a near word: how many, and the near word of largest n (ties: the
    smallest in code-point order), with its n. Words are distinct and not null.

    Words are tiled by shared prefixes and shared suffixes (see _keyed). A key's words go to blocks of about 1,024, and each
    pair of blocks is a tile: a dense comparison in a task that holds two blocks. What leaves a task is a row a word.
    """
    keyed = common.saved(_keyed(words), "spell-keyed")
    sizes = common.saved(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "spell-sizes")
    blocked = common.join_groups(keyed, sizes, "key", "size", ["word"]).where("size is not null")
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    dealt = blocked.withColumn("mine", F.pmod(F.xxhash64(F.lit("block"), "word"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tile = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    rows = dealt.select(tile.alias("tile"), "word", "n", "of", "longer", (F.col("kind") == "s").alias("suffix"), "mine", (F.col("mine") == F.col("other")).alias("alone"))
    found = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form), whose links never run in circles: pointers are doubled until none moves."""
    state = common.saved(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        above = state.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = common.saved(state.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "spell-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        state = moved.select("word", "root")


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words(word, n): the form is the near word of largest n, if that is `factor` times
    the word's n at least, else null; the root is the last of the forms from word on. Words without near words have n_near 0."""
    words = common.saved(words.select("word", "n"), "spell-words")
    joined = words.join(near_words(words), "word", "left")
    fits = F.col("form_n") >= factor * F.col("n")
    rows = common.saved(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "spell-forms")
    return rows.join(_roots(rows.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_tiled_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, with slips: word, n, n_near, form, form_n, root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(word_counts(docs))


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP12_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS named FROM r WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(named, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 | (ord(x)::BIGINT >> 6), 128 | (ord(x)::BIGINT & 63)] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1]))) AS h FROM b),
s AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS z FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT x.word AS u, y.word AS o, y.n FROM v x JOIN v y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.a || v.z
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.a || v.z),
g AS (SELECT u, count(*) AS n_near, arg_min(o, (-n, o)) AS o, max(n) AS m FROM p GROUP BY u),
f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN o END AS form, CASE WHEN m >= 5 * n THEN m END::BIGINT AS form_n FROM w LEFT JOIN g ON u = word),
t AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.*, t.at AS root FROM f JOIN t ON t.word = f.word AND t.next IS NULL
"""
