"""Near-duplicate documents by ProbMinHash signatures of weighted word shingles.

A shingle's weight is how often it stands in the document. Each shingle sends a Poisson process of arrivals, at its weight's
rate, to the components of the signature; a component keeps the earliest arrival. Two components agree with the probability
Jaccard similarity. Arrivals are made in rounds: a shingle goes on only while its next arrival could still be the earliest of
some component, so nearly all stop after the first one.

Documents with equal words are one class from the start. Signatures are cut into bands; documents with an equal band are
candidates. A band's group is worked off around leaders, never as all pairs: every member is compared with the group's most central
document, verified links are contracted to components, and members outside of the group's largest component are compared with
the hub of that component. What is left are pairs of different components: all of them in small groups, in large ones those that
share a rare difference from a common center (or, where shingles repeat, a rare shingle); both are exact prefix filters, so copies
far from their center with changes of their own make no pairs. Similarities are verified on the full texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.common import ready, words_of
from skein.session import stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
SMALL_GROUP = 32
SHARE_TOKENS = 1 << 16  # of a large family, in one task
EPS = 1e-6


# --- signatures --------------------------------------------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, ends: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``n`` words of several documents; a document of fewer words, but not none, is one shingle.

    ``hashes`` are the word hashes of all documents in a row, ``ends`` where each document ends.
    """
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    counts = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(ends)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    h = np.ascontiguousarray(hashes, np.int64).view(np.uint64)
    out = np.full(len(at), 7, np.uint64)
    for j in range(n):
        place = at + j
        inside = place < ends[doc]
        word = h[np.minimum(place, max(len(h) - 1, 0))] if len(h) else np.empty(0, np.uint64)
        out = np.where(inside, _mix(out * np.uint64(0x9E3779B97F4A7C15) + word), out)
    return doc, out


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of the different shingles of each document."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, bool)
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """ProbMinHash: for each document and component the hash of the shingle that arrives first (0 for documents without any)."""
    best = np.full((docs, size), np.inf)
    owner = np.zeros((docs, size), np.uint64)
    time, live, turn = np.zeros(len(h)), np.arange(len(h)), 0
    while len(live):
        turn += 1
        draw = _mix(h[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        uniform = ((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        time[live] -= np.log(uniform) / weight[live]
        component = (_mix(draw + np.uint64(1)) % np.uint64(size)).astype(np.int64)
        slot = doc[live] * size + component
        order = np.lexsort((h[live], time[live], slot))
        lead = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])]
        where, when = slot[lead], time[live][lead]
        won = when < best.reshape(-1)[where]
        best.reshape(-1)[where[won]] = when[won]
        owner.reshape(-1)[where[won]] = h[live][lead][won]
        live = live[time[live] < best.max(axis=1)[doc[live]]]
    return owner


def band_keys(owner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(owner), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(owner), b + 1, np.uint64)
        for r in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + owner[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, n: int = SHINGLE) -> float:
    """Probability Jaccard of two documents given by their word hashes: how likely both draw the same shingle by weight.

    For shingles of weights x and y it is the sum over common ones of 1 / sum of max(x' / x, y' / y) over all.
    """
    (_, ha, wa), (_, hb, wb) = (weighted(*shingles(w, np.array([len(w)]), n)) for w in (a, b))
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    # sum of max(x'/x, y'/y) = sum of x'/x where x'/y' is at least x/y, else of y'/y: sort by the ratio x'/y'
    alone_a, alone_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    above = np.searchsorted(ratio, ratio, side="left")
    sums_x = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]]) + alone_a
    sums_y = np.concatenate([[0.0], np.cumsum(y)]) + alone_b
    return float((1 / (sums_x[above] / x + sums_y[above] / y)).sum())


# --- the job -----------------------------------------------------------------------------------------------------------------

def _word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def signed_rows(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, shingle: int) -> DataFrame:
    """Every row as (id, t, some, c1, c2, keys): ``some`` if it has words, the 128-bit hash of its words, and its band keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["h"], 400_000):
                hashes = batch["h"].iloc[part].tolist()
                doc, h, w = weighted(*shingles(np.concatenate(hashes), np.cumsum([len(x) for x in hashes]), shingle))
                keys = band_keys(signatures(doc, h, w, len(hashes), bands * rows), bands, rows)
                yield batch.iloc[part][["id", "t", "some", "c1", "c2"]].assign(keys=list(keys))

    kind = dict(docs.dtypes)[id_col]
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), _word_hashes(F.col(text_col)).alias("h"))
    known = read.select("id", "t", (F.size("h") > 0).alias("some"), F.xxhash64("h").alias("c1"), F.xxhash64(F.lit("second"), F.col("h")).alias("c2"), "h")
    return known.mapInPandas(run, f"id {kind}, t long, some boolean, c1 long, c2 long, keys array<long>")


def _node() -> Column:
    return F.concat(F.hex("c1"), F.lit(":"), F.hex("c2")).alias("node")


def slices(arrays: pd.Series, words: int) -> Iterator[slice]:
    """Runs of rows of at most so many words together, one row at least."""
    first, held = 0, 0
    for i, size in enumerate(map(len, arrays)):
        if held and held + size > words:
            yield slice(first, i)
            first, held = i, 0
        held += size
    if len(arrays):
        yield slice(first, len(arrays))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(a, b) of the pairs whose texts, given as word hashes, are similar enough."""
    @F.pandas_udf("double")
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.asarray(x), np.asarray(y), shingle) for x, y in zip(a, b)], dtype=float)

    left = texts.select(F.col("node").alias("a"), F.col("h").alias("ha"))
    right = texts.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    met = pairs.join(left, "a").join(right, "b")
    return met.where(measure("ha", "hb") >= threshold - 1e-9).select("a", "b")


def _components(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(node, label) after joining the labels that ``links`` connect; by rounds of smallest neighbours and pointer jumping."""
    edges = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb").select("la", "lb")
    edges = stage(edges.unionAll(edges.select(F.col("lb").alias("la"), F.col("la").alias("lb"))).distinct(), f"{name}-edges")
    if edges.isEmpty():
        return labels
    at = stage(edges.groupBy("la").agg(F.min("lb").alias("m")).select("la", F.least("la", "m").alias("root")), f"{name}-roots")
    while True:
        # each label takes the smallest root among its own, its neighbours' and that of its root
        n = at.select(F.col("la").alias("lb"), F.col("root").alias("nr"))
        low = edges.join(n, "lb").groupBy("la").agg(F.min("nr").alias("nr"))
        up = at.select(F.col("la").alias("root"), F.col("root").alias("rr"))
        new = at.join(low, "la").join(up, "root", "left").select(
            "la", F.least("root", "nr", F.coalesce("rr", "root")).alias("root"), F.col("root").alias("old"))
        new = stage(new, f"{name}-roots")
        if new.where("root <> old").isEmpty():
            break
        at = new.select("la", "root")
    return stage(labels.join(at, F.col("label") == F.col("la"), "left").select("node", F.coalesce("root", "label").alias("label")), f"{name}-labels")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE,
                 bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, t (hash of the text), class_id, class_size, kept.

    A class is a component of links of similarity ``threshold`` or more; ``class_id`` is its smallest id, and that row is kept.
    Texts without words, null and empty ones among them, are a class each and all kept. Rows without an id come last; rows
    equal in id and text are in one class, and all of them stay if one does.
    """
    all_rows = stage(signed_rows(ready(docs), id_col, text_col, bands, rows, shingle), "near-rows")
    who = F.struct(F.col("id").isNull().alias("late"), "id", "t")
    reps = all_rows.where("some").groupBy("c1", "c2").agg(F.min(who).alias("who"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    reps = stage(reps.withColumn("node", _node()), "near-classes")
    keyed = reps.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stage(keyed.join(sizes, "key"), "near-groups")
    # a document in the middle of many copies shares most bands with most of them
    nodes = stage(groups.groupBy("node").agg(F.struct((-F.sum("n")).alias("rank"), F.col("node")).alias("central")), "near-nodes")
    labels = nodes.select("node", F.col("node").alias("label"))
    named = reps.select("node", F.col("who.id").alias("__id"), F.col("who.t").alias("__t"))
    wanted = named.join(nodes, "node", "left_semi")
    raw = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    met = raw.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t"))).dropDuplicates(["node"])
    texts = stage(met.select("node", _word_hashes(F.col("text")).alias("h")), "near-texts")
    done = None
    for propose in (_leaders, _hubs, _rest):
        # a group whose members are all one component by now has nothing left to compare
        live = groups.select("key", "node").join(labels, "node")
        open_ = live.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        live = stage(live.join(open_, "key").join(nodes, "node"), "near-live")
        pairs = propose(live, texts, threshold, shingle).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stage(pairs, "near-pairs")
        links = stage(_verified(pairs, texts, threshold, shingle), "near-links")
        labels = _components(labels, links, "near")
        done = pairs if done is None else done.unionAll(pairs)
    named = named.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "__id", "__t")
    counted = named.join(reps.select("node", "copies"), "node")
    best = counted.groupBy("label").agg(F.min(F.struct(F.col("__id").isNull().alias("late"), F.col("__id").alias("id"), F.col("__t").alias("t"))).alias("best"),
                                        F.sum("copies").alias("class_size"))
    known = stage(named.join(best, "label").select("node", "best", "class_size"), "near-known")
    out = all_rows.withColumn("node", F.when(F.col("some"), _node())).join(known, "node", "left")
    return out.select(F.col("id").alias("doc_id"), "t", F.when(F.col("some"), F.col("best.id")).otherwise(F.col("id")).alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                      (~F.col("some") | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("t") == F.col("best.t")))).alias("kept"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _leaders(live: DataFrame, *_) -> DataFrame:
    """Every member with the most central member of its group."""
    leader = live.groupBy("key").agg(F.min("central").alias("lead"))
    return live.join(leader, "key").where("node <> lead.node").select(*_pair("node", "lead.node"))


def _main(live: DataFrame) -> DataFrame:
    """``live`` with ``main``, the label of the group's largest component."""
    sizes = live.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    return live.join(sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "key")


def _hubs(live: DataFrame, *_) -> DataFrame:
    """Members outside of their group's largest component with the most central document of that component."""
    hubs = live.groupBy(F.col("label").alias("main")).agg(F.min("central").alias("hub"))
    return _main(live).where("label <> main").join(hubs, "main").select(*_pair("node", "hub.node"))


def _rest(live: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Pairs of different components that may still be similar.

    Groups with the same largest component are one family. In families of up to ``SMALL_GROUP`` members these are all such pairs of
    a group, so a member has a bounded number of them; those of larger ones come from prefix filters (``_delta_pairs``, ``_mass_pairs``).
    """
    marked = stage(_main(live), "near-marked")
    family = stage(marked.select("main", "node", "label", "central").distinct(), "near-families")
    large = family.groupBy("main").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > SMALL_GROUP).select("main")
    small = marked.join(large, "main", "left_anti")
    x = small.where("label <> main").select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
    pairs = x.join(small.select("key", "node", "label", "main"), "key").where("label <> lx and (label = main or x < node)").select(*_pair("x", "node"))
    family = family.join(large, "main", "left_semi")
    centers = family.where("label = main").groupBy("main").agg(F.min("central")["node"].alias("center"))
    family = stage(_differences(family.join(centers, "main"), texts, shingle), "near-family")
    to_center = family.where("away").select(*_pair("node", "center"))
    pairs = pairs.unionAll(to_center).unionAll(_delta_pairs(family.where("plain"), threshold))
    odd = family.where("not plain").select("main").distinct()
    return pairs if odd.isEmpty() else pairs.unionAll(_mass_pairs(family.join(odd, "main", "left_semi"), texts, threshold, shingle))


def _differences(members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``members`` with what tells them from their family's center.

    ``own`` are the shingles that only the member holds, ``common`` those that only the center holds, under a hash of their own; ``n``
    and ``nc`` the numbers of different shingles of both; ``plain``: no shingle stands twice in either; ``away``: not in the main component.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, hc in zip(batch["h"], batch["hc"]):
                (_, a, wa), (_, c, wc) = (weighted(*shingles(np.asarray(x), np.array([len(x)]), shingle)) for x in (h, hc))
                own, gone = np.setdiff1d(a, c, True), _mix(np.setdiff1d(c, a, True) + np.uint64(1))
                out.append((len(a), len(c), bool((wa == 1).all() and (wc == 1).all()), own.view(np.int64), gone.view(np.int64)))
            n, nc, plain, own, gone = zip(*out) if out else ((), (), (), (), ())
            yield batch[["main", "node", "label", "center", "away"]].assign(n=n, nc=nc, plain=plain, own=list(own), common=list(gone))

    told = members.withColumn("away", F.col("label") != F.col("main")).join(texts, "node").join(
        texts.select(F.col("node").alias("center"), F.col("h").alias("hc")), "center")
    return told.select("main", "node", "label", "center", "away", "h", "hc").mapInPandas(
        run, "main string, node string, label string, center string, away boolean, n long, nc long, plain boolean, own array<long>, common array<long>")


def _placed(sets: DataFrame) -> DataFrame:
    """Tokens (main, node, t, before) that may be a pair's first common one; ``before``: the weight of the member's tokens ahead of t.

    ``sets`` is (main, node, own, own_w, common, common_w, cap): tokens and weights apart from those of the family's center and from
    its side, and how much may stand ahead. The order of a family is rarest first, ties by token. Tokens of one member only stand ahead
    of all others and are left out. Tokens travel as arrays: a family's members are dealt to shares of about ``SHARE_TOKENS`` tokens, a
    share counts its tokens and deals them to as many parts, a part adds the counts of all shares up and tells each share those that two
    members hold. So neither a share nor a part grows with the family, and only tokens that pass become rows.
    """
    def counted(share: pd.DataFrame) -> pd.DataFrame:
        t, df = np.unique(np.concatenate([*share["own"], *share["common"]]).astype(np.int64), return_counts=True)
        part = t % np.int64(share["shares"].iloc[0])
        by = np.argsort(part, kind="stable")
        parts, first = np.unique(part[by], return_index=True)
        return pd.DataFrame({"main": share["main"].iloc[0], "share": share["share"].iloc[0], "part": parts,
                             "t": np.split(t[by], first[1:]) if len(t) else [], "df": np.split(df[by], first[1:]) if len(t) else []})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        t, size = np.concatenate(part["t"].tolist()), part["t"].map(len).to_numpy()
        known, at = np.unique(t, return_inverse=True)
        df = np.bincount(at, np.concatenate(part["df"].tolist()), len(known)).astype(np.int64)[at]
        met = df > 1
        cuts = np.cumsum(np.bincount(np.repeat(np.arange(len(part)), size)[met], minlength=len(part)))[:-1]
        out = part[["main", "share"]].assign(t=np.split(t[met], cuts), df=np.split(df[met], cuts))
        return out[out["t"].map(len) > 0]

    def run(share: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        known, known_df = (np.concatenate([np.empty(0, np.int64), *met[c]]) for c in ("t", "df"))
        by = np.argsort(known)
        known, known_df, out = known[by], known_df[by], []
        for row in share.itertuples(index=False):
            t, w = np.concatenate([row.own, row.common]).astype(np.int64), np.concatenate([row.own_w, row.common_w]).astype(np.int64)
            at = np.searchsorted(known, t)
            in_two = np.append(known, 0)[at] == t
            in_two &= at < len(known)
            alone, t, w, df = w[~in_two].sum(), t[in_two], w[in_two], known_df[at[in_two]]
            by = np.lexsort((t, df))
            before = alone + np.cumsum(w[by]) - w[by]
            use = before <= row.cap
            out.append((t[by][use], before[use]))
        t, before = zip(*out) if out else ((), ())
        return share[["main", "node"]].assign(t=list(t), before=list(before))

    shares = F.floor(F.sum(F.size("own") + F.size("common")) / SHARE_TOKENS) + 1
    dealt = sets.join(sets.groupBy("main").agg(shares.alias("shares")), "main").withColumn("share", F.pmod(F.xxhash64("node"), "shares"))
    met = dealt.groupBy("main", "share").applyInPandas(counted, "main string, share long, part long, t array<long>, df array<long>").groupBy(
        "main", "part").applyInPandas(added, "main string, share long, t array<long>, df array<long>")
    found = dealt.groupBy("main", "share").cogroup(met.groupBy("main", "share")).applyInPandas(
        run, "main string, node string, t array<long>, before array<long>")
    return found.select("main", "node", F.explode(F.arrays_zip("t", "before")).alias("z")).select("main", "node", "z.t", "z.before")


def _delta_pairs(family: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components, one of them away from the main one, whose differences from the center may overlap enough.

    Let j be the threshold, k = (1 - j) / (1 + j), c the center, D(x) the difference of x and c, d its size. Sets are similar by j
    if they differ in k (|x| + |y|) shingles at most; as |D(x) - D(y)| = d(x) + d(y) - 2 |D(x) & D(y)| counts these, they need
    common(x, y) = (d(x) + d(y) - k (|x| + |y|)) / 2 common differences. A document x that is not similar to c has
    d(x) > k (|x| + |c|), so y needs more than (d(y) + k (|c| - |y|)) / 2, about half of its differences; x itself needs more than
    (d(x) - k (|x| + |c|)) / 2 because d(y) is at least ||y| - |c||. Both are above zero. With one order of differences, rarest
    first, the first common one leaves room for the rest on either side, which bounds its place. Pairs of x with c are compared
    apart, so an x that is similar to c is in the main component then, and any y it could link is met from y's side.
    """
    k = (1 - threshold) / (1 + threshold)
    need = F.greatest(F.lit(1.0), (F.col("d") - k * (F.col("n") + F.col("nc"))) / 2)
    half = F.greatest(F.lit(1.0), (F.col("d") + k * (F.col("nc") - F.col("n"))) / 2)
    ones = {f"{c}_w": F.transform(c, lambda _: F.lit(1).cast("long")) for c in ("own", "common")}
    known = family.withColumn("d", F.size("own") + F.size("common")).withColumns({"need": need, "half": half})
    sets = known.withColumns(ones).withColumn("cap", F.col("d") - F.least("half", F.when(F.col("away"), F.col("need"))) + EPS)
    placed = _placed(sets).join(known.select("main", "node", "label", "away", "n", "d", "need", "half"), ["main", "node"])
    room = F.col("d") - F.col("before")
    placed = placed.select("main", "t", "node", "label", "n", "d", room.alias("room"), (room + EPS >= F.col("half")).alias("as_y"),
                           (F.col("away") & (room + EPS >= F.col("need"))).alias("as_x"))
    placed = stage(placed.where("as_x or as_y"), "near-rare")
    y = placed.where("as_y").select("main", "t", *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "n", "d", "room")])
    common = (F.col("d") + F.col("y_d") - k * (F.col("n") + F.col("y_n"))) / 2
    fits = (F.least("n", "y_n") + EPS >= threshold * F.greatest("n", "y_n")) & (F.least("room", "y_room") + EPS >= common)
    return placed.where("as_x").join(y, ["main", "t"]).where((F.col("label") != F.col("y_label")) & fits).select(*_pair("node", "y_node"))


def _mass_pairs(family: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Pairs with a document that is not plain: they share a shingle before which both hold little.

    If x holds the share u of its weight outside of y, and y the share v outside of x, the probability Jaccard is at most
    1 / (1 + u / (1 - u) + v / (1 - v)): each common shingle adds at most 1 / (1 / x' + v / y') for its shares x' and y', which is
    concave, so the sum is at most the same of the sums. With one order of shingles, rarest first, all before the first common one
    is outside of the other document.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, hc in zip(batch["h"], batch["hc"]):
                (_, t, w), (_, c, _) = (weighted(*shingles(np.asarray(x), np.array([len(x)]), shingle)) for x in (h, hc))
                inside, t = np.isin(t, c), t.view(np.int64)
                out.append((t[~inside], w[~inside], t[inside], w[inside], w.sum()))
            own, own_w, common, common_w, mass = zip(*out) if out else ((), (), (), (), ())
            yield batch[["main", "node", "label", "away", "plain"]].assign(
                own=list(own), own_w=list(own_w), common=list(common), common_w=list(common_w), mass=mass)

    most = 1 / threshold - 1
    told = family.select("main", "node", "label", "away", "plain", "center").join(texts, "node").join(
        texts.select(F.col("node").alias("center"), F.col("h").alias("hc")), "center")
    sets = stage(told.select("main", "node", "label", "away", "plain", "h", "hc").mapInPandas(
        run, "main string, node string, label string, away boolean, plain boolean, own array<long>, own_w array<long>, "
        "common array<long>, common_w array<long>, mass long"), "near-sets")
    placed = _placed(sets.withColumn("cap", (most + EPS) / (1 + most + EPS) * F.col("mass") + EPS)).join(
        sets.select("main", "node", "label", "away", "plain", "mass"), ["main", "node"])
    placed = placed.withColumn("odds", F.col("before") / (F.col("mass") - F.col("before"))).where(F.col("odds") <= most + EPS)
    placed = stage(placed.select("main", "t", "node", "label", "away", "plain", "odds"), "near-rare")
    y = placed.select("main", "t", *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "away", "plain", "odds")])
    met = placed.where("not plain").join(y, ["main", "t"]).where("label <> y_label and (away or y_away) and (y_plain or node < y_node)")
    return met.where(F.col("odds") + F.col("y_odds") <= most + EPS).select(*_pair("node", "y_node"))


def near_free(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns: one document of each class stays."""
    gone = near_classes(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__t")), "left_anti")
