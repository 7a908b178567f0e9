"""Similarity join of documents on word shingles, size-aware (heavy-light), with exact results.

Two sets link when their Jaccard similarity is at least `percent`. Documents with equal sets are
one class from the start (a 64-bit signature of the set), so copies cost nothing further on.

1. Shingles are hashed batch by batch and dealt to buckets by hash range, packed: one row per
   (task, bucket) with 5 bytes a shingle and 2 for the document. A bucket counts in how many
   classes each shingle lies. The few shingles which lie in over `HOT` of all classes are known
   from the first pass (at most shingles-per-document / HOT of them, broadcast) and skip the
   buckets, so no bucket grows with a passage that everybody shares.
2. Packed again by class: shingles that lie in one class only can never be shared, so a class that
   has more of them than a linked one may differ in is out. What stays is a table of the others
   with their shared shingles, the rarest first (an order all classes agree on).
3. Of linked sets, the first n - ceil(n * percent / 100) + k shingles share k at least. Light sets
   (up to a boundary size) enumerate the 2-subsets of that prefix (k = 2); heavy sets scan the
   inverted lists of the prefix shingles (k = 1), in which light sets lie too. The boundary is
   chosen by cost, from counts over all sets by size.
4. A list of classes with a common key must not become all its pairs. Lists with the same most
   central member (the hub: fewest shingles of its own) are one group. Each member is checked against
   the hub, exactly, and components are formed; a group that is one component is done. In the
   others, what lies outside the hub's component is compared with all of the group, in blocks of
   bounded size by matrix products, of which only the pairs that join components come out. After
   that every two classes with a common key are checked, or known to be in one component.

Each step is an aggregate that combines before the shuffle, or a join that the adaptive planner
can split, so a list that a third of all classes lie in has no task of its own.

Shingles are compared by 64-bit hashes (40 bits within a bucket); a chance collision can change an
intersection by one in some 10**9 comparisons.

Defined cases: words are runs without ASCII white space, A-Z lower-cased; null or empty texts and
texts without words have an empty set and link with nothing, not even each other; with fewer than
`words` words the whole sequence is the one shingle; repeated rows are documents of their own; a
null doc_id is never the id of a component unless all its ids are null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, arrow_rows, claim, gram_hashes, hot_join, mix64, table, text_bytes, tidy, token_hashes, tokens, written
from .components import components

WORDS, PERCENT, HOT = 5, 75, 0.02
POSTINGS, BUCKETS, FLUSH = 2_000_000, 32, 500_000
#: What a list entry costs to read in a block comparison, in rows shuffled; a subset or list entry to write costs one.
SCAN_COST = 0.001
#: Shingles in a block of sets that is compared with another, and columns of the comparison's matrices.
BLOCK_SHINGLES, COLUMNS = 150_000, 4096
LOCAL_HOT = 0.015


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number and hash of each document's distinct shingles, ordered; and how many each document has."""
    raw, offsets = text_bytes(texts)
    starts, ends, doc = tokens(raw, offsets)
    h = token_hashes(raw, starts, ends)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    docs, grams = [], []
    for k in range(1, words + 1):
        g = gram_hashes(h, k)
        if k == words:
            on = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
        else:
            on = first[count == k]
        docs.append(doc[on])
        grams.append(g[on])
    doc, g = np.concatenate(docs), np.concatenate(grams)
    bits = U(max(1, n.bit_length()))
    order = np.argsort((doc.astype(U) << (U(64) - bits)) | (g >> bits))  # equal shingles of a document lie side by side
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    doc, g = doc[new], g[new]
    return doc, g, np.bincount(doc, minlength=n)


def signatures(doc: np.ndarray, g: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit signature of each document's set; 0 for the empty one."""
    total = np.zeros(len(count), U)
    some = np.flatnonzero(count)
    if len(some):
        total[some] = np.add.reduceat(mix64(g ^ U(0x5851F42D4C957F2D)), (np.cumsum(count) - count)[some])
    out = mix64(total + count.astype(U) * U(0x9E3779B97F4A7C15))
    out[out == 0] = 1
    out[count == 0] = 0
    return out


def _first_of(sig: np.ndarray) -> np.ndarray:
    """Mask of the first row of each signature, the empty set's left out."""
    out = np.zeros(len(sig), bool)
    out[np.unique(sig, return_index=True)[1]] = True
    return out & (sig != 0)


def _sets(words: int):
    """Rows (doc_id, n, sig), and rows (null, count, shingle) of shingles that are frequent within a batch."""

    def run(batches):
        claim(__name__)
        for b in batches:
            doc, g, count = shingles(b.column(1), words)
            sig = signatures(doc, g, count)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count.astype("i8")), pa.array(sig.view("i8")), pa.array(np.zeros(len(sig), bool))], names=["doc_id", "n", "sig", "hot"])
            new = _first_of(sig)
            value, held = np.unique(g[new[doc]], return_counts=True)
            often = held >= max(4, LOCAL_HOT * new.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(int(often.sum()), pa.int64()), pa.array(held[often]), pa.array(value[often].view("i8")), pa.array(np.ones(int(often.sum()), bool))], names=["doc_id", "n", "sig", "hot"])

    return run


def _packed(docs: np.ndarray, sig: np.ndarray, low: np.ndarray, extra: tuple[np.ndarray, ...] = ()) -> bytes:
    """Postings as bytes: signatures, document number, 40-bit value."""
    used, index = np.unique(docs, return_inverse=True)
    head = np.array([len(used), len(docs)], "<u4")
    return b"".join(x.tobytes() for x in (head, sig[used], index.astype("<u2"), (low & U(0xFFFFFFFF)).astype("<u4"), (low >> U(32)).astype("u1"), *extra))


def _unpacked(blob: bytes, extra: tuple[str, ...] = ()) -> tuple[np.ndarray, ...]:
    """Signature and 40-bit value of each posting, and the extra columns."""
    n, m = np.frombuffer(blob, "<u4", 2).tolist()
    at, out = 8, []
    for kind, k in (("<u8", n), ("<u2", m), ("<u4", m), ("u1", m), *((e, m) for e in extra)):
        out.append(np.frombuffer(blob, kind, k, at))
        at += out[-1].nbytes
    return out[0][out[1]], out[2].astype(U) | (out[3].astype(U) << U(32)), *out[4:]


def _groups(key: np.ndarray):
    """(value, row numbers) for each value of key."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(key[rows[0]]), rows


def _post(words: int, buckets: int, hot):
    """Postings packed by (kind, bucket): kind 0 by shingle, for counting; kind 1 by class, of hot shingles."""

    def flush(doc, g, sig):
        often, held = hot.value
        at = np.searchsorted(often, g)
        is_hot = (often[np.minimum(at, len(often) - 1)] == g) if len(often) else np.zeros(len(g), bool)
        kinds, keys, blobs = [], [], []
        cold = np.flatnonzero(~is_hot)
        bucket = ((g[cold] >> U(40)) * U(buckets)) >> U(24)
        for b, rows in _groups(bucket.astype(np.int64)):
            rows = cold[rows]
            kinds.append(0)
            keys.append(b)
            blobs.append(_packed(doc[rows], sig, g[rows] & U((1 << 40) - 1)))
        warm = np.flatnonzero(is_hot)
        for b, rows in _groups(((sig[doc[warm]] >> U(40)) * U(buckets) >> U(24)).astype(np.int64)):
            rows = warm[rows]
            kinds.append(1)
            keys.append(b)
            blobs.append(_packed(doc[rows], sig, at[rows].astype(U), (held[at[rows]], np.full(len(rows), 0xFFFFFF, "<u4"))))
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])

    def run(batches):
        claim(__name__)
        docs, grams, sigs, n, size = [], [], [], 0, 0
        for b in batches:
            doc, g, count = shingles(b.column(1), words)
            sig = signatures(doc, g, count)
            on = _first_of(sig)[doc]
            docs.append(doc[on] + n)
            grams.append(g[on])
            sigs.append(sig)
            n += len(sig)
            size += int(on.sum())
            if size >= FLUSH or n > 60_000:
                yield flush(np.concatenate(docs), np.concatenate(grams), np.concatenate(sigs))
                docs, grams, sigs, n, size = [], [], [], 0, 0
        if n:
            yield flush(np.concatenate(docs), np.concatenate(grams), np.concatenate(sigs))

    return run


def _counted(buckets: int):
    """A bucket's postings with in how many classes each shingle lies, packed by class."""

    def run(key, rows):
        claim(__name__)
        bucket = key[0].as_py()
        parts = [_unpacked(x.as_py()) for x in rows["blob"]]
        sig, low = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        del parts
        order = np.argsort((low << U(24)) | (sig >> U(40)))
        sig, low = sig[order], low[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (low[1:] != low[:-1])
        sig, low = sig[new], low[new]
        start = np.ones(len(low), bool)
        start[1:] = low[1:] != low[:-1]
        run_of = np.cumsum(start) - 1
        held = np.bincount(run_of)[run_of] if len(low) else run_of
        keys, blobs = [], []
        for b, at in _groups(((sig >> U(40)) * U(buckets) >> U(24)).astype(np.int64)):
            s, h, v = sig[at], held[at], low[at]
            classes, index = np.unique(s, return_inverse=True)
            alone = np.bincount(index[h == 1], minlength=len(classes)).astype("<u4")
            k = h > 1
            head = np.array([len(classes), int(k.sum())], "<u4")
            blob = b"".join(x.tobytes() for x in (head, classes, alone, index[k].astype("<u4"), (v[k] & U(0xFFFFFFFF)).astype("<u4"), (v[k] >> U(32)).astype("u1"), np.minimum(h[k], 65534).astype("<u2")))
            keys.append(b)
            blobs.append(np.array([bucket], "<u4").tobytes() + blob)
        return pa.table([pa.array(np.zeros(len(keys), "i4")), pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])

    return run


def _survivors(percent: int):
    """Classes that can link: size, how many shingles they have alone, the others with the rarest first, and the length of their lists."""

    def run(key, rows):
        claim(__name__)
        sigs, values, often, lone, alone = [], [], [], [], []
        for kind, blob in zip(rows["kind"].to_pylist(), rows["blob"], strict=True):
            blob = blob.as_py()
            if kind == 1:  # hot shingles, of a single task: copies of a class in other tasks bring the same again
                s, v, d, b = _unpacked(blob, ("<u2", "<u4"))
                sigs.append(s)
                values.append((b.astype(U) << U(40)) | v)
                often.append(d)
                continue
            bucket = int(np.frombuffer(blob, "<u4", 1)[0])
            n, m = np.frombuffer(blob, "<u4", 2, 4).tolist()
            at, x = 12, []
            for t, k in (("<u8", n), ("<u4", n), ("<u4", m), ("<u4", m), ("u1", m), ("<u2", m)):
                x.append(np.frombuffer(blob, t, k, at))
                at += x[-1].nbytes
            lone.append(x[0])
            alone.append(x[1])
            sigs.append(x[0][x[2]])
            values.append((U(bucket) << U(40)) | (x[4].astype(U) << U(32)) | x[3].astype(U))
            often.append(x[5])
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        sig, value, held, lone, alone = cat(sigs, U), cat(values, U), cat(often, "<u2").astype(np.int64), cat(lone, U), cat(alone, "<u4").astype(np.int64)
        order = np.lexsort((value, held, sig))
        sig, value, held = sig[order], value[order], held[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (value[1:] != value[:-1])
        sig, value, held = sig[new], value[new], held[new]
        classes, first, shared = np.unique(sig, return_index=True, return_counts=True)
        single = np.zeros(len(classes), np.int64)
        at = np.searchsorted(classes, lone)
        there = at < len(classes)
        there[there] = classes[at[there]] == lone[there]
        np.add.at(single, at[there], alone[there])
        n = single + shared
        prefix = n - (n * percent + 99) // 100 + 1
        keep = np.flatnonzero(single < prefix)
        first, shared, n, single, prefix = first[keep], shared[keep], n[keep], single[keep], prefix[keep]
        total = np.append(0, np.cumsum(held))
        scan = total[np.minimum(first + prefix - single, first + shared)] - total[first]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(shared)), pa.int32()), pa.array(np.concatenate([value[a : a + k] for a, k in zip(first, shared, strict=True)]).view("i8") if len(keep) else np.zeros(0, "i8")))
        return pa.table([pa.array(classes[keep].view("i8")), pa.array(n), pa.array(single), lists, pa.array(scan)], names=["sig", "n", "single", "shared", "scan"])

    return run


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig) of all documents, and the classes that could link: sig, n, single, shared, scan."""
    spark = docs.sparkSession
    arrow_rows(spark)
    own = written(docs.mapInArrow(tidy(_sets(words)), "doc_id long, n long, sig long, hot boolean"), "sets")
    sets = own.where("not hot").select("doc_id", "n", "sig")
    found, total = sets.agg(F.count(F.lit(1)), F.sum("n")).first()
    hot = own.where("hot").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= max(64, HOT * found)).toArrow()
    value, held = hot["sig"].to_numpy().view(U), np.minimum(hot["n"].to_numpy(), 65534).astype("<u2")
    order = np.argsort(value)
    hot = spark.sparkContext.broadcast((value[order], held[order]))
    buckets = max(BUCKETS, -(-(total or 0) // POSTINGS))
    posted = docs.mapInArrow(tidy(_post(words, buckets, hot)), "kind int, bucket int, blob binary")
    # one row of a bucket stands for up to a million postings
    cold = posted.where("kind = 0").groupBy("bucket").applyInArrow(_counted(buckets), "kind int, bucket int, blob binary")
    if len(value):
        cold = cold.unionByName(posted.where("kind = 1"))
    left = cold.groupBy("bucket").applyInArrow(_survivors(percent), "sig long, n long, single long, shared array<long>, scan long")
    return sets, written(left, "classes")


def boundary(left: DataFrame, percent: int = PERCENT) -> int:
    """The largest size for which enumerating subsets is cheaper than scanning lists, over all sets up to it and beyond it."""
    step = F.floor(F.log2("n") * 8)
    k = _prefix(percent) + 1 - F.col("single")
    cost = left.groupBy(step.alias("step")).agg(F.max("n").alias("n"), F.sum(k * (k - 1) / 2).alias("light"), F.sum(k - 1 + F.col("scan") * SCAN_COST).alias("heavy")).orderBy("step").collect()  # at most 8 rows per doubling of the size
    best, here = 0, sum(r["heavy"] for r in cost)
    least = here
    for r in cost:
        here += r["light"] - r["heavy"]
        if here < least:
            least, best = here, r["n"]
    return best


def _prefix(percent: int):
    return (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).cast("long")


def _keys(left: DataFrame, percent: int, light: int) -> DataFrame:
    """(key, lists, sig, heavy, alone): the subsets of light sets, and the list entries of all sets if any is heavy."""
    base = left.select("sig", "n", "shared", (F.col("single") / F.col("n")).alias("alone"), (F.col("n") > light).alias("heavy"), (_prefix(percent) - F.col("single")).cast("int").alias("k"))
    base = base.withColumn("one", F.slice("shared", F.lit(1), F.col("k"))).withColumn("two", F.slice("shared", F.lit(1), F.col("k") + 1))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("two") - 1), lambda i: F.transform(F.slice("two", i + 1, F.size("two")), lambda x: F.xxhash64(F.element_at("two", i), x))))
    subsets = base.where((F.col("n") <= light) & (F.size("two") >= 2)).select(F.explode(pairs).alias("key"), F.lit(False).alias("lists"), "sig", "heavy", "alone")
    return subsets.unionByName(base.select(F.explode("one").alias("key"), F.lit(True).alias("lists"), "sig", "heavy", "alone"))


def _groups_of(left: DataFrame, percent: int) -> DataFrame:
    """(hub, sig): for each list its most central member and the others, lists of the same hub as one group."""
    keys = written(_keys(left, percent, boundary(left, percent)), "keys")
    hubs = keys.groupBy("key", "lists").agg(F.count(F.lit(1)).alias("c"), F.max("heavy").alias("h"), F.min(F.struct(~F.col("heavy"), "alone", "sig")).alias("m")).where("c > 1 and (h or not lists)")
    hubs = hubs.select(F.col("key").alias("k"), F.col("lists").alias("l"), F.col("m.sig").alias("hub"))
    found = keys.join(hubs, (keys["key"] == hubs["k"]) & (keys["lists"] == hubs["l"])).where("sig <> hub").select("hub", "sig").distinct()
    return written(found, "groups")


def _checked(pairs: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    side = lambda c: left.select(F.col("sig").alias(f"{c}_sig"), F.col("n").alias(f"{c}_n"), F.col("shared").alias(f"{c}_set"))
    both = pairs.join(side("a"), pairs["a"] == F.col("a_sig")).join(side("b"), pairs["b"] == F.col("b_sig"))
    both = both.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(common * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent).select("a", "b")


def _joined(sig: np.ndarray, comp: np.ndarray, part: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets in two blocks (part 0 and 1, or one block of part 0): pairs that make the components of the links across components within them."""
    a = np.flatnonzero(part == 0)
    b = np.flatnonzero(part == 1) if part.any() else a
    value = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    value, index, count = np.unique(value, return_inverse=True, return_counts=True)
    on = count[index] > 1
    row, index = row[on], (np.cumsum(count > 1) - 1)[index[on]]
    order = np.argsort(index, kind="stable")
    row, index = row[order], index[order]
    common = np.zeros((len(a), len(b)), np.float32)
    place = np.zeros(len(sets), np.int64)
    place[a] = np.arange(len(a))
    same = b is a
    if not same:
        place[b] = np.arange(len(b))
    for lo in range(0, int(index[-1]) + 1 if len(index) else 0, COLUMNS):
        i, j = np.searchsorted(index, (lo, lo + COLUMNS))
        r, c = row[i:j], index[i:j] - lo
        x = np.zeros((len(a), COLUMNS), np.float32)
        first = part[r] == 0
        x[place[r[first]], c[first]] = 1
        y = x
        if not same:
            y = np.zeros((len(b), COLUMNS), np.float32)
            y[place[r[~first]], c[~first]] = 1
        common += x @ y.T
    link = (common * (100 + percent) >= (n[a][:, None] + n[b][None, :]) * percent) & (comp[a][:, None] != comp[b][None, :])
    i, j = np.nonzero(link)
    # spanning pairs of the components that these links and the known ones make: hook onto the smallest, jump, again
    names, at = np.unique(comp, return_inverse=True)
    u, v = at[a[i]], at[b[j]]
    label = np.arange(len(names))
    while len(u):
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _compare(percent: int):
    def run(batches):
        claim(__name__)
        for b in batches:
            out = [[], []]
            for k in range(len(b)):
                rows = b.column(0)[k].values
                sig, comp, part, n, shared = (rows.field(f) for f in ("sig", "comp", "part", "n", "shared"))
                offsets, flat = shared.offsets.to_numpy(), shared.values.to_numpy()
                # within a list of structs the fields may begin before it
                sets = [flat[offsets[i] : offsets[i + 1]] for i in range(len(sig))]
                x, y = _joined(sig.to_numpy(), comp.to_numpy(), part.to_numpy(), n.to_numpy(), sets, percent)
                out[0].append(x)
                out[1].append(y)
            cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cat], names=["a", "b"])

    return run


def links(left: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(v, comp): the components of classes that link with any other."""
    spark = left.sparkSession
    groups = _groups_of(left, percent)
    star = written(_checked(groups.select(F.col("hub").alias("a"), F.col("sig").alias("b")), left, percent), "star")
    comp = written(components(star), "star-components")
    # members with their components; groups that are not one component yet
    known = lambda v, c: comp.select(F.col("v").alias(v), F.col("comp").alias(c))
    at = hot_join(groups, "hub", known("v2", "c2"), "v2").join(known("v1", "c1"), F.col("sig") == F.col("v1"), "left")
    at = written(at.select("hub", "sig", F.coalesce("c1", "sig").alias("comp"), F.coalesce("c2", "hub").alias("main")), "members")
    open_ = at.where("comp <> main").select(F.col("hub").alias("h")).distinct()
    at = hot_join(at, "hub", written(open_, "open-hubs"), "h", "inner").drop("h")
    at = at.unionByName(at.select("hub", F.col("hub").alias("sig"), F.col("main").alias("comp"), "main").distinct()).withColumn("other", F.col("comp") != F.col("main"))
    sets = left.select(F.col("sig").alias("s"), "n", "shared")
    at = written(at.join(sets, at["sig"] == sets["s"]).drop("s", "main"), "open")
    size = at.groupBy("hub").agg(*[F.ceil(F.sum(F.when(F.col("other") == k, F.size("shared")).otherwise(0)) / BLOCK_SHINGLES).cast("int").alias(c) for k, c in ((True, "others"), (False, "mains"))]).withColumnRenamed("hub", "h")
    at = hot_join(at, "hub", written(size, "blocks"), "h", "inner").drop("h")
    block = F.pmod(F.xxhash64("sig"), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains"))).cast("int")
    # blocks 0.. are of the other components, those from `others` on of the hub's; two of the latter hold no open pair
    at = at.withColumn("own", F.when(F.col("other"), block).otherwise(block + F.col("others")))
    mates = F.when(F.col("other"), F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") - 1))
    at = at.withColumn("mate", F.explode(mates))
    at = at.withColumns({"lo": F.least("own", "mate"), "hi": F.greatest("own", "mate")})
    row = F.struct("sig", "comp", (F.col("own") > F.col("lo")).cast("int").alias("part"), F.col("n"), "shared")
    arrow_rows(spark, 8)
    # dealt by pairs of blocks: a deal by hub would do for this grouping, and leave all blocks of a group to one task
    rows = at.repartition("hub", "lo", "hi").groupBy("hub", "lo", "hi").agg(F.collect_list(row).alias("rows")).select("rows")  # two blocks, bounded by BLOCK_SHINGLES
    more = written(rows.mapInArrow(tidy(_compare(percent)), "a long, b long"), "more")
    arrow_rows(spark)
    return components(star.unionByName(more))


def similarity_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, and component_id: the smallest doc_id that links lead to."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets, left = classes(docs, words, percent)
    comp = links(left, percent)
    named = written(hot_join(sets, "sig", comp, "v").select("doc_id", "n", "sig", F.coalesce("comp", "sig").alias("comp")), "named")
    least = written(named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least")).withColumnRenamed("comp", "c"), "least")
    out = hot_join(named, "comp", least, "c")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))
