"""Over- and undersampling (O1-O9, U1-U11), applied to a fold's training part only.

Class sizes come from one grouped count (k <= 30 rows).  Random choices are md5 hashes of
(seed, row key), so results are reproducible and need no sort.  "Keep exactly n rows of a
class" never ranks a whole class in one window: rows are histogrammed by hash bin per class,
the boundary bin is found on the small histogram, and only that bin is ranked.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.split import hash_unit
from loupe.session import staged

LABEL, FEATURES, KEY = "label_idx", "features", "_key"
#: Clusters of a class whose centres the driver holds at most.
CENTRES_MOST = 256
# Sampler codes.
OVERSAMPLERS = {"NOG": "none", "RND": "random", "SME": "SMOTE", "SNC": "SMOTE-NC", "SNN": "SMOTE-N",
                "ADA": "ADASYN", "BRD": "Borderline-SMOTE", "KMS": "KMeans-SMOTE", "SVM": "SVM-SMOTE"}
UNDERSAMPLERS = {"NUG": "none", "RND": "random", "CCS": "cluster centroids", "ENN": "edited NN",
                 "RNN": "repeated edited NN", "AKN": "all k-NN", "IHT": "instance hardness threshold",
                 "NMS": "NearMiss-1", "NCR": "neighbourhood cleaning", "OSS": "one-sided selection",
                 "TKL": "Tomek links"}


def with_key(df: DataFrame, key: str | None) -> DataFrame:
    """The frame with its row key as the text column ``_key``."""
    if KEY in df.columns:
        return df
    if key is None:
        raise ValueError("resampling needs the name of a unique key column")
    return df.withColumn(KEY, F.col(key).cast("string"))


def class_sizes(df: DataFrame) -> dict[float, int]:
    return {float(r[LABEL]): int(r["n"]) for r in df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}


def take_per_class(df: DataFrame, targets: dict[float, int], seed: int, bins: int = 4096,
                   order: Column | None = None, key: str | None = None) -> DataFrame:
    """Exactly min(target, n_c) rows of each class: those with the smallest ``order`` value, ties by
    key (default: a seeded hash of the key).  Only the boundary bin of each class is ranked.  Hash
    values are cut into equal bins; other orders into ranges of equal numbers of rows, written once."""
    cols = df.columns
    df = with_key(df, key)
    if order is None:
        h = df.withColumn("_u", hash_unit(seed, F.col(KEY), 3))
        h = h.withColumn("_bin", F.least(F.floor(F.col("_u") * bins), F.lit(bins - 1)).cast("int"))
    else:
        h = df.withColumn("_u", order.cast("double")).repartitionByRange(LABEL, "_u", KEY)
        h = staged(h.withColumn("_bin", F.spark_partition_id()), "ranges")
    hist = h.groupBy(LABEL, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    tmap = F.create_map(*[x for c, t in targets.items() for x in (F.lit(float(c)), F.lit(int(t)))])
    w = Window.partitionBy(LABEL).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    plan = (hist.withColumn("_cum", F.sum("_n").over(w)).withColumn("_target", tmap[F.col(LABEL)])
            .withColumn("_before", F.col("_cum") - F.col("_n"))
            .select(LABEL, "_bin", "_before", "_target",
                    F.when(F.col("_cum") <= F.col("_target"), "all").when(F.col("_before") >= F.col("_target"), "none")
                    .otherwise("part").alias("_mode")))
    j = h.join(F.broadcast(plan), [LABEL, "_bin"])
    keep_all = j.filter(F.col("_mode") == "all")
    part = j.filter(F.col("_mode") == "part").withColumn(
        "_r", F.row_number().over(Window.partitionBy(LABEL, "_bin").orderBy("_u", KEY))).filter(
        F.col("_before") + F.col("_r") <= F.col("_target"))
    return keep_all.select(*cols).unionByName(part.select(*cols))


def random_undersample(df: DataFrame, seed: int = 0, key: str | None = None) -> DataFrame:
    """Every class cut to the smallest class size."""
    df = with_key(df, key)
    sizes = class_sizes(df)
    n_min = min(sizes.values())
    return take_per_class(df, {c: n_min for c in sizes}, seed)


def random_oversample(df: DataFrame, seed: int = 0, key: str | None = None) -> DataFrame:
    """O2: every class grown to the largest size: q copies of each row plus one more for the
    r rows with the smallest hash (q, r = divmod(n_max, n_c)).  Copies have keys of their own."""
    df = with_key(df, key)
    sizes = class_sizes(df)
    n_max = max(sizes.values())
    qmap = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(n_max // n))])
    extra = take_per_class(df, {c: n_max % n for c, n in sizes.items()}, seed)
    base = df.withColumn("_i", F.explode(F.sequence(F.lit(1), qmap[F.col(LABEL)])))
    both = base.unionByName(extra.withColumn("_i", F.lit(0)))
    copy = F.when(F.col("_i") == 1, F.col(KEY)).otherwise(F.concat_ws("#", KEY, F.lit(f"copy{seed}"), F.col("_i")))
    return both.withColumn(KEY, copy).drop("_i")


# ------------------------------------------------------------------ synthetic rows
def _x(df: DataFrame) -> DataFrame:
    return df.withColumn("_x", vector_to_array(F.col(FEATURES)))


def _spread(base: DataFrame, n_new: int, seed: int) -> DataFrame:
    """base with _m, the number of synthetic rows of each row: n_new dealt evenly, exactly."""
    n_base = base.count()
    if not n_base:
        return base.withColumn("_m", F.lit(0))
    q, r = divmod(n_new, n_base)
    more = take_per_class(base.select(KEY, F.lit(0.0).alias(LABEL)), {0.0: r}, seed).select(KEY, F.lit(1).alias("_one"))
    return base.join(more, KEY, "left").withColumn("_m", F.lit(q) + F.coalesce("_one", F.lit(0))).drop("_one")


def _make(df: DataFrame, base: DataFrame, others: DataFrame, label: float, k: int, seed: int, space: str = "_x",
          combine=None, nn: DataFrame | None = None) -> DataFrame:
    """Synthetic rows: for each of base(_key, _x, _m) its _m rows, by default on the line to one of its k
    nearest rows of ``others``.  ``space`` names the array that distances are taken in; ``combine``
    (x, drawn neighbour, all k neighbours, uniform number) makes the new array otherwise; ``nn``: the k nearest
    rows (``knn_join``), if they are known."""
    from loupe.operators.knn import knn_join
    base = staged(base.where(F.col("_m") > 0), "seeds")
    if nn is None:
        nn = knn_join(base.select(KEY, space), others.select(KEY, space), k, KEY, KEY, x=space, exclude_self=True, seed=seed)
    near = nn.join(others.select(F.col(KEY).alias(f"right_{KEY}"), F.col("_x").alias("_nx")), f"right_{KEY}")
    near = near.groupBy(F.col(f"left_{KEY}").alias(KEY)).agg(F.sort_array(F.collect_list(F.struct("rank", "_nx"))).alias("_near"))
    rows = base.join(near, KEY).withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_m"))))
    drawn = F.element_at(F.col("_near"), (F.pmod(F.xxhash64(KEY, "_j", F.lit(seed)), F.size("_near")) + 1).cast("int"))["_nx"]
    u = hash_unit(seed, F.concat_ws("|", KEY, "_j"), 1)
    line = F.zip_with(F.col("_x"), drawn, lambda a, b: a + u * (b - a))
    new = line if combine is None else combine(F.col("_x"), drawn, F.transform("_near", lambda n: n["_nx"]), u)
    rows = rows.select(array_to_vector(new).alias(FEATURES), F.lit(float(label)).alias(LABEL),
                       F.concat_ws("#", KEY, F.lit(f"new{seed}"), F.col("_j")).alias(KEY))
    rest = [c for c in df.columns if c not in (FEATURES, LABEL, KEY)]
    return rows.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in rest}).select(*df.columns)


def _short(df: DataFrame) -> tuple[dict[float, int], dict[float, int]]:
    """Class sizes, and how many rows each smaller class lacks."""
    sizes = class_sizes(df)
    n_max = max(sizes.values(), default=0)
    return sizes, {c: n_max - n for c, n in sizes.items() if n < n_max}


def smote(df: DataFrame, seed: int = 0, k: int = 5, seeds: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """O3 SMOTE: rows x + u (nn - x) between a row and one of its k nearest rows of the same class, until
    all classes have the size of the largest.  ``seeds`` (column _key) restricts the rows that are
    interpolated from (Borderline, SVM variants).  A class of one row is left as it is."""
    df = with_key(df, key)
    sizes, need = _short(df)
    out = df
    for c, n_new in need.items():
        if sizes[c] < 2:
            continue
        cls = _x(df.filter(F.col(LABEL) == c)).select(KEY, "_x")
        base = cls if seeds is None else cls.join(seeds.select(KEY), KEY, "left_semi")
        out = out.unionByName(_make(df, _spread(base, n_new, seed), cls, c, min(k, sizes[c] - 1), seed))
    return out


def adasyn(df: DataFrame, seed: int = 0, k: int = 5, key: str | None = None) -> DataFrame:
    """O6 ADASYN: a smaller class's rows get synthetic rows in proportion to the share of other classes
    among their k nearest rows (rounded), between them and their k nearest rows of the class."""
    df = with_key(df, key)
    sizes, need = _short(df)
    hard = staged(_neighbour_labels(df, k).select(KEY, LABEL, "_x", (
        F.size(F.filter("_nbrs", lambda s: s["_ny"] != F.col(LABEL))) / F.size("_nbrs")).alias("_r")), "hardness")
    total = {float(r[LABEL]): r["s"] for r in hard.groupBy(LABEL).agg(F.sum("_r").alias("s")).collect()}
    out = df
    for c, n_new in need.items():
        if sizes[c] < 2 or not total.get(c):
            continue
        cls = hard.filter(F.col(LABEL) == c)
        base = cls.select(KEY, "_x", F.rint(F.col("_r") / total[c] * n_new).cast("int").alias("_m"))
        out = out.unionByName(_make(df, base, cls.select(KEY, "_x"), c, min(k, sizes[c] - 1), seed))
    return out


def _mode(values: Column) -> Column:
    """The most frequent value of an array, the smallest of equally frequent ones."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(
        (-F.size(F.filter(values, lambda w: w == v))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def _at(arrays: Column, i: int) -> Column:
    """Element i of each array."""
    return F.transform(arrays, lambda a: a[i])


def smote_nc(df: DataFrame, categorical: list[int], seed: int = 0, k: int = 5, key: str | None = None) -> DataFrame:
    """O4 SMOTE-NC: ``categorical`` are the positions of the category codes in ``features``.  In distances
    two different codes count as the median standard deviation of the class's continuous features; a
    new row takes the most frequent code among the k neighbours, and interpolates the rest."""
    df = with_key(df, key)
    sizes, need = _short(df)
    out, cats = df, sorted(set(categorical))
    for c, n_new in need.items():
        if sizes[c] < 2:
            continue
        cls = _x(df.filter(F.col(LABEL) == c)).select(KEY, "_x")
        d = int(cls.select(F.size("_x")).first()[0])
        numeric = [i for i in range(d) if i not in cats]
        spread = cls.agg(*[F.stddev_pop(F.col("_x")[i]).alias(f"s{i}") for i in numeric]).first() if numeric else ()
        cost = sorted(spread)[len(spread) // 2] if numeric else 1.0
        codes = {i: sorted(r[0] for r in cls.select(F.col("_x")[i]).distinct().collect()) for i in cats}
        one_hot = [F.when(F.col("_x")[i] == v, F.lit(float(cost) / 2**0.5)).otherwise(F.lit(0.0)) for i in cats for v in codes[i]]
        cls = staged(cls.withColumn("_space", F.array(*[F.col("_x")[i] for i in numeric], *one_hot)), "mixed")

        def combine(x, drawn, near, u):
            return F.array(*[_mode(_at(near, i)) if i in cats else x[i] + u * (drawn[i] - x[i]) for i in range(d)])
        out = out.unionByName(_make(df, _spread(cls, n_new, seed), cls, c, min(k, sizes[c] - 1), seed, "_space", combine))
    return out


def smote_n(df: DataFrame, seed: int = 0, k: int = 5, key: str | None = None) -> DataFrame:
    """O5 SMOTE-N for category codes only: distances are value differences (two codes are as far apart as
    the class shares of their rows, squared), and a new row takes each feature's most frequent code
    among its k nearest rows."""
    df = with_key(df, key)
    sizes, need = _short(df)
    labels, out = sorted(sizes), df
    x = staged(_x(df).select(KEY, LABEL, "_x"), "codes")
    d = int(x.select(F.size("_x")).first()[0])
    shares = (x.select(LABEL, F.posexplode("_x").alias("feature", "code")).groupBy("feature", "code")
              .agg(*[(F.sum((F.col(LABEL) == c).cast("int")) / F.count(F.lit(1))).alias(f"p{j}") for j, c in enumerate(labels)])).collect()
    table = {}  # as long as the categories of all features
    for r in shares:
        table.setdefault(r["feature"], []).append((r["code"], [r[f"p{j}"] for j in range(len(labels))]))
    parts = []
    for i in range(d):
        codes = F.create_map(*[v for code, p in table[i] for v in (F.lit(code), F.array(*[F.lit(q) for q in p]))])
        parts.append(codes[F.col("_x")[i]])
    x = staged(x.withColumn("_space", F.flatten(F.array(*parts))), "values")
    for c, n_new in need.items():
        if sizes[c] < 2:
            continue
        cls = x.filter(F.col(LABEL) == c).select(KEY, "_x", "_space")

        def combine(_own, _drawn, near, _u):
            return F.array(*[_mode(_at(near, i)) for i in range(d)])
        out = out.unionByName(_make(df, _spread(cls, n_new, seed), cls, c, min(k, sizes[c] - 1), seed, "_space", combine))
    return out


def kmeans_smote(df: DataFrame, seed: int = 0, k: int = 5, clusters: int = 8, key: str | None = None) -> DataFrame:
    """O8 KMeans-SMOTE: all rows are clustered; clusters in which a smaller class has at least its share of
    all rows get its synthetic rows, the sparser (the larger the mean distance to the k nearest rows
    of the class in the cluster) the more, made by SMOTE inside the cluster.  Neighbours are searched once (again
    where keys repeat), in eight clusters at a time."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans

    from loupe.operators.knn import knn_join
    df = with_key(df, key)
    sizes, need = _short(df)
    n = sum(sizes.values())
    fitted = KMeans(k=min(clusters, max(2, n - 1)), seed=seed, featuresCol=FEATURES, predictionCol="_cl").fit(df)
    rows = staged(_x(fitted.transform(df)).select(KEY, LABEL, "_x", "_cl"), "clusters")
    held = {(r["_cl"], float(r[LABEL])): r["n"] for r in rows.groupBy("_cl", LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows, n_keys = rows.agg(F.count(F.lit(1)), F.count_distinct(KEY)).first()
    of_cluster = {}
    for (cl, _), m in held.items():
        of_cluster[cl] = of_cluster.get(cl, 0) + m
    out = df
    for c, n_new in need.items():
        parts = {}
        for cl, total in sorted(of_cluster.items()):
            m = held.get((cl, c), 0)
            if m < 2 or m / total < sizes[c] / n:
                continue
            parts[cl] = rows.filter((F.col(LABEL) == c) & (F.col("_cl") == cl)).select(KEY, "_x")

        def searched(cl, c=c, parts=parts):
            nn = staged(knn_join(parts[cl], parts[cl], min(k, held[(cl, c)] - 1), KEY, KEY, x="_x", exclude_self=True), "near")
            return nn, float(nn.agg(F.avg("dist")).first()[0] or 0.0) + 1e-12

        with ThreadPool(8) as pool:
            near = dict(zip(parts, pool.map(inheritable_thread_target(df.sparkSession)(searched), parts)))
        weight = {cl: far for cl, (_, far) in near.items()}
        whole, given = sum(weight.values()), 0
        for j, cl in enumerate(weight):
            share = n_new - given if j == len(weight) - 1 else round(n_new * weight[cl] / whole)
            share = min(share, n_new - given)
            given += share
            out = out.unionByName(_make(df, _spread(parts[cl], share, seed), parts[cl], c, min(k, held[(cl, c)] - 1), seed, nn=near[cl][0] if n_keys == n_rows else None))
    return out


def borderline_smote(df: DataFrame, seed: int = 0, k: int = 5, m: int = 10, key: str | None = None) -> DataFrame:
    """O7 Borderline-SMOTE: only rows in danger (at least half, but not all, of their m nearest rows are of
    other classes) are interpolated from."""
    df = with_key(df, key)
    j = _neighbour_labels(df, m)
    other = F.size(F.filter("_nbrs", lambda s: s["_ny"] != F.col(LABEL)))
    return smote(df, seed, k, seeds=staged(j.filter((other * 2 >= F.size("_nbrs")) & (other < F.size("_nbrs"))).select(KEY), "danger"))


def svm_smote(df: DataFrame, seed: int = 0, k: int = 5, key: str | None = None) -> DataFrame:
    """O9 SVM-SMOTE: only support vectors of a linear SVM (margin up to 1) are interpolated from."""
    from pyspark.ml.classification import LinearSVC
    df = with_key(df, key)
    sizes = class_sizes(df)
    largest = max(sizes, key=lambda c: sizes[c])
    binary = df.withColumn("_b", (F.col(LABEL) != largest).cast("double"))
    fitted = LinearSVC(featuresCol=FEATURES, labelCol="_b", maxIter=50).fit(binary)
    margin = F.abs(vector_to_array(F.col("rawPrediction"))[1])
    return smote(df, seed, k, seeds=staged(fitted.transform(binary).filter(margin <= 1.0).select(KEY), "support"))


# ------------------------------------------------------------------ cleaning
def _neighbour_labels(df: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """The rows with _x and _nbrs: (rank, id, label) of the k nearest other rows."""
    from loupe.operators.knn import knn_join
    keyed = _x(df)
    nn = knn_join(keyed.select(KEY, "_x"), keyed.select(KEY, "_x", F.col(LABEL).alias("_ny")), k, KEY, KEY,
                  x="_x", exclude_self=True, seed=seed, right_cols=("_ny",))
    agg = nn.groupBy(F.col(f"left_{KEY}").alias(KEY)).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col(f"right_{KEY}").alias("id"), "_ny"))).alias("_nbrs"))
    return keyed.join(agg, KEY, "left")


def _minority(df: DataFrame) -> float:
    sizes = class_sizes(df)
    return min(sizes, key=lambda c: (sizes[c], c))


def edited_nn(df: DataFrame, k: int = 3, seed: int = 7, kind_sel: str = "all", key: str | None = None) -> DataFrame:
    """U4 ENN: rows of non-minority classes are dropped when their k nearest neighbours do not
    all share their class (``kind_sel='mode'``: when the majority vote disagrees)."""
    df = with_key(df, key)
    j = _neighbour_labels(df, k, seed)
    same = F.size(F.filter(F.col("_nbrs"), lambda s: s["_ny"] == F.col(LABEL)))
    agree = (same == F.size(F.col("_nbrs"))) if kind_sel == "all" else (same * 2 > F.size(F.col("_nbrs")))
    return j.filter((F.col(LABEL) == _minority(df)) | agree).select(*df.columns)


def repeated_enn(df: DataFrame, k: int = 3, max_iter: int = 100, seed: int = 7, key: str | None = None) -> DataFrame:
    """ENN until nothing changes (each round is written)."""
    cur = with_key(df, key)
    n = cur.count()
    for _ in range(max_iter):
        cur = staged(edited_nn(cur, k, seed), "enn")
        m = cur.count()
        if m == n:
            break
        n = m
    return cur


def all_knn(df: DataFrame, k: int = 3, seed: int = 7, key: str | None = None) -> DataFrame:
    """ENN with k = 1..k in turn."""
    cur = with_key(df, key)
    for kk in range(1, k + 1):
        cur = staged(edited_nn(cur, kk, seed), "enn")
    return cur


def tomek_links(df: DataFrame, seed: int = 7, key: str | None = None, keep: float | None = None) -> DataFrame:
    """Drop the members, other than of the smallest class (or class ``keep``), of every mutual 1-NN pair
    with different labels."""
    df = with_key(df, key)
    keep = _minority(df) if keep is None else keep
    near = staged(_neighbour_labels(df, 1, seed).select(KEY, LABEL, F.col("_nbrs")[0]["id"].alias("_to"), F.col("_nbrs")[0]["_ny"].alias("_tl")), "links")
    back = near.select(F.col(KEY).alias("_to"), F.col("_to").alias("_back"))
    links = near.join(back, "_to").filter((F.col("_back") == F.col(KEY)) & (F.col(LABEL) != F.col("_tl")) & (F.col(LABEL) != keep))
    return df.join(links.select(KEY), KEY, "left_anti").select(*df.columns)


def near_miss(df: DataFrame, k: int = 3, seed: int = 7, key: str | None = None) -> DataFrame:
    """U8 NearMiss-1: keep, per majority class, the n_min rows with the smallest mean distance to
    their k nearest minority rows."""
    from loupe.operators.knn import knn_join
    df = with_key(df, key)
    sizes = class_sizes(df)
    minority = _minority(df)
    n_min = sizes[minority]
    keyed = _x(df)
    mino, maj = keyed.filter(F.col(LABEL) == minority), keyed.filter(F.col(LABEL) != minority)
    nn = knn_join(maj.select(KEY, "_x"), mino.select(KEY, "_x"), min(k, n_min), KEY, KEY, x="_x", seed=seed)
    md = nn.groupBy(F.col(f"left_{KEY}").alias(KEY)).agg(F.avg("dist").alias("_md"))
    kept = take_per_class(maj.join(md, KEY), {c: n_min for c in sizes if c != minority}, seed, order=F.col("_md"))
    return mino.select(*df.columns).unionByName(kept.select(*df.columns))


def neighbourhood_cleaning(df: DataFrame, k: int = 3, share: float = 0.5, seed: int = 7, key: str | None = None) -> DataFrame:
    """Of the classes other than the smallest, rows that their k nearest rows outvote go, and so do
    the rows among the k nearest of a misclassified minority row, if of a class larger than
    ``share`` times the minority."""
    df = with_key(df, key)
    sizes, minority = class_sizes(df), _minority(df)
    j = staged(_neighbour_labels(df, k, seed).select(KEY, LABEL, "_nbrs", (F.size(F.filter(
        "_nbrs", lambda s: s["_ny"] == F.col(LABEL))) * 2 > F.size("_nbrs")).alias("_agree")), "votes")
    large = [c for c, n in sizes.items() if c != minority and n > share * sizes[minority]]
    outvoted = j.filter((F.col(LABEL) != minority) & ~F.col("_agree")).select(KEY)
    around = (j.filter((F.col(LABEL) == minority) & ~F.col("_agree")).select(F.explode("_nbrs").alias("n"))
              .filter(F.col("n._ny").isin(large)).select(F.col("n.id").alias(KEY)))
    return df.join(outvoted.unionByName(around).distinct(), KEY, "left_anti").select(*df.columns)


def one_sided_selection(df: DataFrame, seed: int = 7, n_seeds: int = 1, key: str | None = None) -> DataFrame:
    """Per class other than the smallest, ``n_seeds`` rows (of the smallest hash) and all rows that
    their nearest row among these and the minority misclassifies stay; then Tomek links go."""
    from loupe.operators.knn import knn_join
    df = with_key(df, key)
    sizes, minority = class_sizes(df), _minority(df)
    small = df.filter(F.col(LABEL) == minority)
    out = small
    for c in sizes:
        if c == minority:
            continue
        cls = df.filter(F.col(LABEL) == c)
        first = staged(take_per_class(cls, {c: n_seeds}, seed), "seeds")
        rest = cls.join(first.select(KEY), KEY, "left_anti")
        known = _x(small.unionByName(first))
        nn = knn_join(_x(rest).select(KEY, "_x"), known.select(KEY, "_x", F.col(LABEL).alias("_ny")), 1, KEY, KEY, x="_x", seed=seed, right_cols=("_ny",))
        wrong = nn.filter(F.col("_ny") != F.lit(float(c))).select(F.col(f"left_{KEY}").alias(KEY))
        out = out.unionByName(first.select(*df.columns)).unionByName(rest.join(wrong, KEY, "left_semi").select(*df.columns))
    return tomek_links(staged(out, "selection"), seed, keep=minority)


def instance_hardness(df: DataFrame, seed: int = 0, algorithm: str = "LRN", folds: int = 5, key: str | None = None) -> DataFrame:
    """Of each larger class the n_min rows stay to which models fitted on the other folds give the
    highest probability of their own class."""
    from loupe.functions.split import fold_column
    from loupe.operators import classifiers as A
    df = with_key(df, key)
    sizes = class_sizes(df)
    n_min, minority = min(sizes.values()), _minority(df)
    k = int(max(sizes)) + 1
    rows = staged(df.withColumn("_f", fold_column(seed, F.col(KEY), folds)), "folds")
    scored = None
    for f in range(folds):
        model = A.fit(algorithm, rows.filter(F.col("_f") != f).select(FEATURES, LABEL), k)
        part = model.transform(rows.filter(F.col("_f") == f).select(KEY, FEATURES, LABEL))
        part = part.select(KEY, F.element_at("probability", F.col(LABEL).cast("int") + 1).alias("_own"))
        scored = part if scored is None else scored.unionByName(part)
    judged = rows.join(staged(scored, "hardness"), KEY)
    kept = take_per_class(judged, {c: (n if c == minority else n_min) for c, n in sizes.items()}, seed, order=-F.col("_own"))
    return kept.select(*df.columns)


def cluster_centroids(df: DataFrame, seed: int = 0, key: str | None = None) -> DataFrame:
    """Each majority class replaced by the means of n_min KMeans clusters.  Centroids are
    computed by a grouped aggregate over the assigned rows, so they stay distributed.  More than
    ``CENTRES_MOST`` clusters are found with the centres as a table (``clusters.py``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.stat import Summarizer

    from loupe.operators.clusters import cluster_means
    df = with_key(df, key)
    sizes = class_sizes(df)
    n_min = min(sizes.values())
    large = [c for c, n in sizes.items() if n > n_min]
    out = df.filter(~F.col(LABEL).isin(large))

    def centroids(part: DataFrame, c) -> DataFrame:
        part = part.withColumn(KEY, F.concat_ws("#", F.lit(f"centre{seed}"), c, F.col("_cl"))).withColumn(LABEL, c)
        rest = [col for col in df.columns if col not in (FEATURES, LABEL, KEY)]
        return part.withColumns({col: F.lit(None).cast(df.schema[col].dataType) for col in rest}).select(*df.columns)

    if n_min > CENTRES_MOST and large:
        found = cluster_means(_x(df.filter(F.col(LABEL).isin(large))).select(LABEL, F.col("_x").alias("x")), n_min, large, seed)
        return out.unionByName(centroids(found.select(LABEL, F.col("c").alias("_cl"), F.col("x").alias(FEATURES)), F.col(LABEL)))
    for c in large:
        cls = df.filter(F.col(LABEL) == c)
        km = KMeans(k=n_min, seed=seed, featuresCol=FEATURES, predictionCol="_cl").fit(cls)
        part = km.transform(cls).groupBy("_cl").agg(Summarizer.mean(F.col(FEATURES)).alias(FEATURES))
        out = out.unionByName(centroids(part, F.lit(float(c))))
    return out


def oversample(code: str, df: DataFrame, seed: int = 0, key: str | None = None, categorical: list[int] | None = None) -> DataFrame:
    """Apply an oversampler by its code; ``categorical`` (positions of category codes) is for SMOTE-NC."""
    if code == "NOG":
        return df
    if code == "SNC":
        if not categorical:
            raise ValueError("SMOTE-NC needs the positions of the category codes among the features")
        return smote_nc(df, categorical, seed, key=key)
    return {"RND": random_oversample, "SME": smote, "SNN": smote_n, "ADA": adasyn, "BRD": borderline_smote,
            "KMS": kmeans_smote, "SVM": svm_smote}[code](df, seed, key=key)


def undersample(code: str, df: DataFrame, seed: int = 0, key: str | None = None) -> DataFrame:
    """Apply an undersampler by its code."""
    if code == "NUG":
        return df
    if code in ("RND", "CCS", "IHT"):
        return {"RND": random_undersample, "CCS": cluster_centroids, "IHT": instance_hardness}[code](df, seed, key=key)
    return {"ENN": edited_nn, "RNN": repeated_enn, "AKN": all_knn, "NMS": near_miss, "NCR": neighbourhood_cleaning,
            "OSS": one_sided_selection, "TKL": tomek_links}[code](df, key=key)
