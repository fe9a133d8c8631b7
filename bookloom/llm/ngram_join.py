"""Exact Jaccard self-join of documents over word shingles, by token-combination prefixes; links become components.

1. Every text becomes a set of 64-bit shingle hashes. Documents with equal sets are one class, known by a hash of the
   set. A fixed share of the hash range is looked at first: a class with more shingles there that nobody else has than
   the threshold lets it miss has no link and goes no further. This needs no order of frequency and is exact.
2. For the classes that are left, shingles are put in order of document frequency. A prefix is extended until any
   similar class must share one of its signatures: single shingles where they are rare, pairs of shingles of the same
   hash class where they are frequent. The number of hash classes follows the size of the set, so that the pairs stay
   in proportion to it; sets near a change of size index both numbers.
3. Within a signature everyone is compared with one hub, the member with the smallest share of shingles of its own.
   Classes that the hubs' links leave in other components than their hub are then compared with all members of the
   hub's bucket that an upper bound still allows: joined on bands of size, and with profiles, the counts of shared
   shingles in PROFILE hash groups, whose sums of minima bound every overlap. No pair that could link is left out, and
   pairs within a found component are never made.

Sets and classes are known by 64-bit hashes: among some 6 * 10**9 different sets one collision is to be expected.

Defined cases: a null or empty text, or one without words, has an empty set and no links; equal texts link; rows that
repeat a doc_id are nodes of their own with the same id; a null doc_id never is the smallest unless there is no other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import free_name, mix64, remove, small_batches, text_steps, written
from bookloom.llm.components import components
from bookloom.llm.shingles import shingle_sets

#: Shingles that at most so many classes have are indexed alone.
RARE = 8
#: Sets of 2**L shingles use 2**L / SPREAD hash classes.
SPREAD = 16
BAND = 1.02
#: Hash groups of a profile.
PROFILE = 64


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def class_hash(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))])).view(np.int64)[0])


def shingled(docs: DataFrame, keep: list[str], width: int, share: float, text_col: str = "text") -> DataFrame:
    """keep, n, class, tokens: the size of the set, the hash of the set, and those of its hashes in the first share of the range."""
    small_batches(docs.sparkSession)
    names = [*keep, "n", "class", "tokens"]
    limit = None if share >= 1 else np.uint64(int(share * 2**64))
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in text_steps(texts):
                sets = shingle_sets([t.as_buffer().to_pybytes() for t in texts.slice(a, b - a)], width)
                n = pa.array([len(s) for s in sets], pa.int64())
                name = pa.array([class_hash(s) for s in sets], pa.int64())
                some = sets if limit is None else [s[: np.searchsorted(s, limit)] for s in sets]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), n, name, _lists(some)], names)

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kept}, n long, class long, tokens array<long>")


def may_miss(n: Column, percent: int) -> Column:
    """How many of its n shingles a set can lack in a set that it links with."""
    return n - F.ceil(n * percent / F.lit(100)).cast("long")


def signatures(df: np.ndarray, token: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Hashes of single rare shingles and of pairs of frequent ones; df and token: of the shingles that others have too."""
    need = n - -(-n * percent // 100) - (n - len(token)) + 1
    if need <= 0 or not len(token):
        return np.empty(0, np.uint64)
    order = np.lexsort((token, df))
    df, token = df[order], token[order]
    rare = df <= RARE
    level = n.bit_length() - 1
    levels = [level, level - 1] if n * percent < 100 << level and level else [level]
    out = []
    for at in levels:
        group = (mix64(token) % np.uint64(max(1, (1 << at) // SPREAD))).astype(np.int64)
        group[rare] = -1
        by = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[by], prepend=-2))
        nth = np.empty(len(token), np.int64)
        nth[by] = np.arange(len(token)) - np.repeat(first, np.diff(np.append(first, len(token))))
        covered = np.cumsum(rare | (nth > 0))
        end = int(np.searchsorted(covered, need)) + 1
        out.append(token[:end][rare[:end]])
        held: dict[int, list[int]] = {}
        for g, t in zip(group[:end].tolist(), token[:end].tolist()):
            if g >= 0:
                held.setdefault(g, []).append(t)
        for pair in held.values():
            t = np.array(pair, np.uint64)
            i, j = np.triu_indices(len(t), 1)
            with np.errstate(over="ignore"):
                out.append(mix64(mix64(np.minimum(t[i], t[j]) + np.uint64(at)) ^ np.maximum(t[i], t[j])))
    return np.unique(np.concatenate(out))


def profile(token: np.ndarray) -> list[int]:
    """How many of the shingles fall into each hash group."""
    return np.bincount((mix64(token ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE).tolist()


def _signature_rows(percent: int):
    """Rows of signatures, and one row without a signature for each class that has its profile."""
    schema = pa.schema([("sig", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("profile", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            pairs = lists.values
            df, token = (pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for name, n, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1], ends[1:]):
                own = token[a:b].view(np.uint64)
                sig = signatures(df[a:b], own, n, percent)
                if len(sig):
                    columns = [pa.array([None, *sig.view(np.int64).tolist()], pa.int64())]
                    columns += [pa.array(np.full(len(sig) + 1, v, np.int64)) for v in (name, n, n - (b - a))]
                    columns.append(pa.array([profile(own)] + [None] * len(sig), schema.field("profile").type))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def profiles_allow(percent: int, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether the overlap that two profiles allow at most is enough: an exact upper bound."""
    most = F.aggregate(F.zip_with(p1, p2, lambda a, b: F.least(a, b)), F.lit(0), lambda x, y: x + y)
    return 100 * most >= percent * (n1 + n2 - most)


def can_link(percent: int, n1: Column, own1: Column, n2: Column, own2: Column) -> Column:
    """Whether sizes and shingles of one's own let two sets link: an exact upper bound."""
    most = F.least(n1 - own1, n2 - own2)
    return 100 * most >= percent * (n1 + n2 - most)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link: the whole sets are compared."""
    one = sets.select(F.col("class").alias("a"), F.col("tokens").alias("_a"))
    two = sets.select(F.col("class").alias("b"), F.col("tokens").alias("_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("_x", F.size(F.array_intersect("_a", "_b")).cast("long"))
    return both.where(100 * F.col("_x") >= percent * (F.size("_a") + F.size("_b") - F.col("_x"))).select("a", "b")


def candidate_signatures(docs: DataFrame, classes: DataFrame, id_col: str, width: int, percent: int, spent: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the classes that may have links: sets (class, n, tokens), sigs (sig, class, n, own), profiles (class, profile)."""
    left = classes.where((F.col("n") > 1) & (F.col("own") <= may_miss(F.col("n"), percent))).select(F.col("class").alias("_class"), F.col("rep").alias("_rep"))
    picked = docs.select(F.col(id_col).alias("_id"), F.col("text")).join(left, F.col("_id").eqNullSafe(F.col("_rep")))
    sets = shingled(picked.select("_class", "text"), ["_class"], width, 1.0).where("class = _class").drop("_class")
    sets = written(sets.dropDuplicates(["class"]), "sets", spent)

    rows = sets.select("class", "n", F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(often, "token").groupBy("class", "n").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    found = written(shared.mapInArrow(_signature_rows(percent), "sig long, class long, n long, own long, profile array<int>"), "signatures", spent)
    return sets, found.where("sig IS NOT NULL").drop("profile"), found.where("sig IS NULL").select("class", "profile")


def class_links(docs: DataFrame, classes: DataFrame, id_col: str, width: int, percent: int, spent: list[str] | None = None) -> DataFrame:
    """Links (a, b) between classes, enough of them to give all components. classes: class, n, rep (one row's id), own."""
    sets, sigs, profiles = candidate_signatures(docs, classes, id_col, width, percent, spent)

    hubs = sigs.groupBy("sig").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("part"), "class", "n", "own")).alias("hub"), F.count("*").alias("many")).where("many > 1")
    members = sigs.join(hubs, "sig").select(F.col("hub.class").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.own").alias("hub_own"), "class", "n", "own")
    members = written(members.distinct(), "members", spent)

    first = members.where((F.col("hub") != F.col("class")) & can_link(percent, F.col("hub_n"), F.col("hub_own"), F.col("n"), F.col("own")))
    links = written(verified(first.select(F.col("hub").alias("a"), F.col("class").alias("b")), sets, percent), "links", spent)

    labels = components(links, spent=spent)
    known = members.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").join(labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub", "left")
    known = known.join(profiles, "class").select("hub", "class", "n", "own", "profile", F.coalesce("label", "class").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label"))
    known = written(known, "known", spent)
    band = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(BAND))).cast("int")
    low, high = F.ceil(F.col("n") * percent / 100), F.floor(F.lit(100) * (F.col("n") - F.col("own")) / percent) - F.col("own")
    apart = known.where((F.col("label") != F.col("hub_label")) & (high >= low)).select(
        "hub", F.col("class").alias("a"), F.col("n").alias("n1"), F.col("own").alias("own1"), F.col("label").alias("label1"), F.col("profile").alias("profile1"), F.explode(F.sequence(band(low), band(high))).alias("band")
    )
    others = known.select("hub", F.col("class").alias("b"), F.col("n").alias("n2"), F.col("own").alias("own2"), F.col("label").alias("label2"), F.col("profile").alias("profile2"), band(F.col("n")).alias("band"))
    on = (apart["hub"] == others["hub"]) & (apart["band"] == others["band"]) & (F.col("label1") != F.col("label2"))
    near = can_link(percent, F.col("n1"), F.col("own1"), F.col("n2"), F.col("own2"))
    rest = apart.join(others, on & near & profiles_allow(percent, F.col("n1"), F.col("profile1"), F.col("n2"), F.col("profile2")))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.unionByName(written(verified(rest, sets, percent), "links", spent))


def sized_classes(docs: DataFrame, id_col: str, width: int, percent: int, spent: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """id_col, n, class of every row; and class, n, rep, own (shingles in the first share that no other class has)."""
    share = min(1.0, 1.6 * (100 - percent) / 100)
    small = shingled(docs, [id_col], width, share)
    own_rows = small.select("class", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("class").alias("class"), F.max("class").alias("last"))
    own = own_rows.where(F.col("class") == F.col("last")).groupBy("class").agg(F.count("*").alias("own"))
    sized = written(small.select(F.col(id_col), "n", "class"), "classes", spent)
    classes = sized.where("n > 0").groupBy("class", "n").agg(F.min(id_col).alias("rep"))
    return sized, written(classes.join(own, "class", "left").select("class", "n", "rep", F.coalesce("own", F.lit(0)).alias("own")), "own", spent)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The whole join: membership (id_col, n_shingles, class) of every row, and every verified link (a, b, with a < b) between classes.

    Its links grow with the square of a group of different near copies, as any listing of links does; near_duplicates
    gives groups without that. Rows of one class link with each other besides.
    """
    sized, classes = sized_classes(docs, id_col, width, percent)
    sets, sigs, profiles = candidate_signatures(docs, classes, id_col, width, percent)
    side = sigs.join(profiles, "class")
    one, two = (side.select("sig", *[F.col(c).alias(f"{c}{k}") for c in ("class", "n", "own", "profile")]) for k in (1, 2))
    near = can_link(percent, F.col("n1"), F.col("own1"), F.col("n2"), F.col("own2")) & profiles_allow(percent, F.col("n1"), F.col("profile1"), F.col("n2"), F.col("profile2"))
    pairs = one.join(two, (one["sig"] == two["sig"]) & (F.col("class1") < F.col("class2")) & near).select(F.col("class1").alias("a"), F.col("class2").alias("b")).distinct()
    return sized.withColumnRenamed("n", "n_shingles"), verified(pairs, sets, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, class, component_id for every row of docs (columns id_col and text), written; all tables on the way are removed."""
    spent: list[str] = []
    sized, classes = sized_classes(docs, id_col, width, percent, spent)

    labels = components(class_links(docs, classes, id_col, width, percent, spent), spent=spent).withColumnRenamed("node", "class")
    named = classes.join(labels, "class", "left").select("class", "rep", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("class", "component_id")
    joined = sized.where("n > 0").join(named, "class").select(id_col, F.col("n").alias("n_shingles"), "class", "component_id")
    empty = sized.where("n = 0").select(id_col, F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("class"), F.col(id_col).alias("component_id"))
    out = written(joined.unionByName(empty), "components")
    remove(docs.sparkSession, spent)
    return out


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five words, 80 in 100) one row stays: of its smallest doc_id, null being the largest.

    Rows count, not ids: of rows that share the smallest doc_id the one with the smallest hash of all columns stays, of
    rows that are alike in every column any one; another text under the doc_id of a near copy is judged by itself.
    Rows with an empty text have no links and all stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = free_name("_key", docs.columns)
    row = F.xxhash64(*columns, *[c.isNull() for c in columns])
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row.alias("row")))
    found = near_duplicates(keyed.select(key, "text"), key).where("n_shingles > 0")
    found = written(found.select(key, (F.col(key) == F.col("component_id")).alias("stays")), "verdicts")
    gone = found.where("NOT stays").select(key)
    again = written(found.where("stays").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "again")
    if again.isEmpty():
        return keyed.join(gone, key, "left_anti").select(*columns)
    one = keyed.join(again, key, "left_semi").dropDuplicates([key])
    return keyed.join(gone.unionByName(again), key, "left_anti").unionByName(one).select(*columns)
