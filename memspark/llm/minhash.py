"""Near-duplicate documents by minhash with tensored banding.

A document is the set of its five-word shingles. Two collections of ``m`` short signatures, each made
of ``r`` minhashes, are computed once; the keys of the m * m tables are all pairs of one signature of
either collection, so 2 * m * r minhashes serve tables that would take 2 * m * m * r of their own.

1. Documents of equal sets form a class, found by a digest of the set; all later steps see classes.
2. Only signatures that another class shares make keys. In each table's bucket the most central class
   is the hub. A member is compared on full sets with the hub it meets in most tables, then with its
   other hubs unless one component holds both by then. No bucket is expanded into pairs.
3. In groups that a hub doesn't explain, members are measured against a pivot set in their midst. The
   one next to it is compared with all. Other pairs can only be linked if they share so many of their
   differences from the pivot, which a prefix filter turns into groups around rare shingles. Of a group
   some members at a time, twice as many each round, are compared with those that are not in their
   component by then, so a group that holds together costs a few rounds and not all its pairs.
4. Links are joined into components.

A hub's set is dealt out to chunks of its partners, so a hub of any number of members is no task's alone.
Texts are read twice and stay where they are: once for signatures, once for the full sets of classes
that have a candidate, named by their place (see ``places``), and in ``deduplicate`` once more for the rows kept.

A link of similarity 0.85 escapes all tables with a chance of about 2 * (1 - 0.85**r)**m, 7e-5 at the
parameters below, and one of 0.80 with 6e-4; more similar ones far more rarely. Shingles are told apart by
64-bit hashes: two sets of 10^5 shingles hold a false common one with a chance of 6e-10, so 10^11
comparisons of sets that long shift some 60 by one shingle.

Cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a
document of fewer words than a shingle is one shingle. A row without doc_id is linked with nothing and
kept. Equal rows share class and component. Extra columns are not looked at, and kept by
``deduplicate``. Empty tables give empty results. Very long texts are hashed piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, places
from . import text as tx
from .components import components
from .files import few

SHINGLE = 5
#: Signatures of a collection, and minhashes of a signature.
M, R = 8, 2
PERCENT = 85
#: Partners that meet one copy of a hub's set; members of a group that are compared with the others in its first round.
PARTNERS, FIRST = 256, 4
#: Parts that the narrow rows of a hub with many partners are looked up in.
SALTS = 64

_RNG = np.random.default_rng(85)
_XOR = _RNG.integers(0, 1 << 63, 2 * M * R, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, 2 * M * R, dtype=np.uint64) | np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the index of each row's first."""
    h, first = tx.word_hashes(buf, offs, tx.SPACELESS)
    wide, at = tx.windows(h, first, width)
    row = tx.row_of(first)[at]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = n[short] > k
            whole[has] = tx.mix(whole[has] * np.uint64(3) + h[first[short[has]] + k])
        wide = np.concatenate([wide, tx.mix(whole + n[short].astype(np.uint64))])
        row = np.concatenate([row, short])
    order = np.argsort(wide)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    wide, row = wide[order], row[order]
    new = np.ones(len(wide), bool)
    new[1:] = (wide[1:] != wide[:-1]) | (row[1:] != row[:-1])
    wide, row = wide[new], row[new]
    return wide, np.searchsorted(row, np.arange(len(offs)))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row with shingles, the 2 * M short signatures."""
    rows = np.flatnonzero(np.diff(first))
    out = np.zeros((len(rows), 2 * M), np.uint64)
    if len(rows):
        at = first[rows]
        for k in range(2 * M):
            for j in range(R):
                low = np.minimum.reduceat((sets ^ _XOR[k * R + j]) * _MUL[k * R + j], at)
                out[:, k] = tx.mix(out[:, k] + low)
    return out


def _digests(sets: np.ndarray, first: np.ndarray) -> list:
    raw = sets.view(np.uint8)
    return [xxhash.xxh3_128_digest(raw[8 * s : 8 * e]) if e > s else None for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _signed(docs: DataFrame) -> DataFrame:
    """Place, doc_id, n_shingles, set_key, signatures a and b, and a hash of the text, of a rooted table's rows."""
    names = ["file", "row", "doc_id", "n_shingles", "set_key", "a", "b", "text_key"]

    def run(batches):
        for batch in batches:
            buf, offs = tx.flat(batch.column(3))
            for lo, hi in tx.slices(offs):
                sets, first = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                n = np.diff(first)
                sig = np.zeros((hi - lo, 2 * M), np.uint64)
                sig[n > 0] = signatures(sets, first)
                bounds = pa.array(np.arange(0, (hi - lo + 1) * M, M, dtype=np.int32))
                both = [pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(x).ravel().view(np.int64))) for x in (sig[:, :M], sig[:, M:])]
                place = [batch.column(k).slice(lo, hi - lo) for k in (0, 1, 2)]
                cols = [*place, pa.array(n, pa.int64()), pa.array(_digests(sets, first), pa.binary()), *both, batch.column(4).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            tx.trim()

    text = docs["text"].cast("string")
    rows = docs.select(*places.place(docs), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.when(text.isNotNull(), F.xxhash64(text)).alias("text_key"))
    return rows.mapInArrow(run, "file string, row long, doc_id long, n_shingles long, set_key binary, a array<bigint>, b array<bigint>, text_key long")


def _sets(docs: DataFrame, folder: str) -> DataFrame:
    """node and shingles of the marked rows."""

    def run(batch, table, lo, hi):
        for a, b in tx.slices(tx.flat(batch.column(0))[1]) if table is not None else ():
            at = a + np.flatnonzero(hi[a:b] > lo[a:b])
            sets, first = shingles(*tx.flat(batch.column(0).take(pa.array(at))))
            node = table.column("node").to_numpy()[lo[at]]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["node", "shingles"])

    return places.beside(docs, [docs["text"].cast("string").alias("text")], folder, run, "node long, shingles array<bigint>")


def _chunked(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """pairs(node, hub), a written table, with the chunk of partners that each falls into; (hub, chunks) of hubs with several; what to join on.

    Most hubs have one chunk, and where all have, pairs stay as they are. The few others are looked up by
    spread keys, so that no task gets all partners of one.
    """
    sized = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PARTNERS).alias("_chunks")).filter("_chunks > 1")
    hot = files.saved(sized, "hot")
    if not files.noted(hot):
        return pairs, None, ["hub"]
    spread = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    both = salted.join(few(spread, 32, files.noted(hot) * SALTS), ["hub", "_salt"], "left")
    both = both.withColumn("_chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.coalesce("_chunks", F.lit(1)))).drop("_salt", "_chunks")
    return files.saved(both, "chunked"), hot, ["hub", "_chunk"]


def _dealt(hubs: DataFrame, hot: DataFrame | None) -> DataFrame:
    """hubs(hub, ..), of which each chunk of partners gets its own copy."""
    if hot is None:
        return hubs
    many = hubs.join(few(hot, 24), "hub", "left")
    return many.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_chunks", F.lit(1)) - 1))).drop("_chunks")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(node, hub), a written table, with both full sets, sa and sb, and the size of their intersection.

    Of the sets only those that a pair asks for are shuffled.
    """
    n = files.noted(pairs)
    chunked, hot, by = _chunked(pairs)
    left = few(chunked, 48, n).join(sets.select("node", F.col("shingles").alias("sa")), "node")
    right = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("sb")).join(few(pairs.select("hub").distinct(), 24, n), "hub", "left_semi")
    both = left.join(_dealt(right, hot).hint("merge"), by).drop("_chunk")
    return both.withColumn("inter", F.size(F.array_intersect("sa", "sb")).cast("long"))


def _linked(percent: int):
    union = F.size("sa") + F.size("sb") - F.col("inter")
    return F.lit(100) * F.col("inter") >= F.lit(percent) * union


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every document's set key; and per key a node, its smallest doc_id, that one's place, and signatures."""
    rows = files.saved(_signed(docs), "signatures")
    with_words = rows.filter("set_key is not null and doc_id is not null")
    per = with_words.groupBy("set_key").agg(F.min(F.struct("doc_id", "file", "row")).alias("one"), F.first("a").alias("a"), F.first("b").alias("b"))
    per = per.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("one.doc_id").alias("rep"), "one.file", "one.row", "a", "b")
    return rows, files.saved(per, "classes")


def hub_pairs(per: DataFrame) -> DataFrame:
    """node, hub, tables: in how many tables a class meets each of its hubs."""
    each = per.select("node", F.posexplode(F.concat("a", "b")).alias("k", "x"))
    crowd = each.groupBy("k", "x").agg(F.count("*").alias("n")).filter("n > 1")
    shared = each.join(crowd.hint("merge"), ["k", "x"]).groupBy("node").agg(F.sum("n").alias("central"), F.bit_or(F.expr("shiftleft(1, k)")).alias("has"))
    live = shared.filter((F.col("has") % (1 << M) > 0) & (F.col("has") >= 1 << M))
    live = files.saved(per.select("node", "a", "b").join(live.hint("merge"), "node"), "live")
    sides = [F.posexplode(c).alias(i, x) for c, i, x in (("a", "i", "x"), ("b", "j", "y"))]
    keys = live.select("node", "central", "has", sides[0], "b").filter("shiftright(has, i) % 2 = 1").select("node", "central", "has", "i", "x", sides[1])
    keys = keys.filter(f"shiftright(has, j + {M}) % 2 = 1").select("node", "central", F.xxhash64("i", "j", "x", "y").alias("key"))
    best = F.max(F.struct("central", (-F.col("node")).alias("minus")))
    hub = keys.groupBy("key").agg(F.count("*").alias("n"), best.alias("hub")).filter("n > 1").select("key", (-F.col("hub.minus")).alias("hub"))
    return keys.select("key", "node").join(hub.hint("merge"), "key").filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("tables"))


def measured(group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, hub, n, f, room, diff: how each member of a hub's group differs from the group's pivot.

    The pivot holds the shingles that most of some 32 members share. Any set would give the same links;
    this one is near to all members, so differences are few. With D shingles of the pivot left out and A
    added, f = (1 - c) * D + c * A and room = (1 - 2 * c) * |pivot|, c = percent / (100 + percent): a
    link of x and y takes at least f_x + f_y - room common differences. Added shingles come first in
    diff, as they are rarer.
    """
    c = percent / (100 + percent)
    chunked, hot, by = _chunked(group)
    # Some 32 members in all: of a group in several chunks fewer of each.
    part = chunked.withColumn("_held", F.count("*").over(Window.partitionBy(*by)))
    part = part.withColumn("_chunks", F.lit(1)) if hot is None else part.join(few(hot, 24), "hub", "left")
    part = part.filter(F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("_held") / 32) * F.coalesce("_chunks", F.lit(1))) == 0).select("node", "hub")
    some = few(files.saved(part.union(group.select(F.col("hub").alias("node"), "hub")).distinct(), "voters"), 24).join(sets, "node")
    votes = some.groupBy("hub").agg(F.count("*").alias("voters"))
    token = some.select("hub", F.explode("shingles").alias("token")).groupBy("hub", "token").agg(F.count("*").alias("k"))
    pivot = token.join(votes.hint("merge"), "hub").groupBy("hub").agg(F.collect_list(F.when(2 * F.col("k") > F.col("voters"), F.col("token"))).alias("pivot"))
    e = few(chunked, 48).join(sets.withColumnRenamed("shingles", "s"), "node").join(_dealt(pivot, hot).hint("merge"), by).drop("_chunk")
    e = e.withColumn("added", F.array_sort(F.array_except("s", "pivot"))).withColumn("missed", F.array_sort(F.array_except("pivot", "s")))
    f = F.lit(1 - c) * F.size("missed") + F.lit(c) * F.size("added")
    return e.select("node", "hub", F.size("s").alias("n"), f.alias("f"), (F.lit(1 - 2 * c) * F.size("pivot")).alias("room"), F.concat("added", "missed").alias("diff"))


_EPS = 1e-9


def _heads(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open members x and all members y, once for each of the first few differences that a link must share.

    ``members`` has node, hub, n, f, low, room, diff, open: low is the smallest f of the group, and open
    tells that the member isn't linked to the one that has it. A link of an open x takes at least
    f_x + low - room > 0 common differences, and more than f_y - low for any y, so that two that are
    linked share one of the first few of their ordered differences. x come with a round: some ``FIRST`` of
    a group go first, then twice as many each time. y come with the last round of theirs, which grows with the
    logarithm of the group they are in.
    """
    size = F.size("diff")
    as_y = size - F.greatest(F.lit(0), F.floor(F.col("f") - F.col("low") + _EPS))
    as_x = size - F.greatest(F.lit(1), F.ceil(F.col("f") + F.col("low") - F.col("room") - _EPS)) + 1

    def side(df: DataFrame, length, name: str) -> DataFrame:
        head = F.slice("diff", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
        at = df.select("hub", F.posexplode(head).alias("at", "token"), "node", "n", "f", "room", size.alias("size"))
        rest = F.col("size") - F.col("at")  # what may still be shared from here on
        return at.select("hub", "token", F.col("node").alias(name), F.col("n").alias(f"n_{name}"), rest.alias(f"rest_{name}"), F.col("f").alias(f"f_{name}"), F.col("room").alias(f"room_{name}"))

    x, y = side(members.filter("open"), as_x, "a"), side(members, as_y, "b")
    # Differences that no open member shares with anyone, most of them by far, lead nowhere.
    crowd = x.groupBy("hub", "token").agg(F.ceil(F.count("*") / FIRST).alias("parts"))
    met = y.groupBy("hub", "token").agg(F.count("*").alias("n")).filter("n > 1").select("hub", "token")
    crowd = files.saved(crowd.join(met.hint("merge"), ["hub", "token"]), "crowd")
    place = F.pmod(F.xxhash64("a", "token"), F.col("parts"))
    crowded = few(crowd, 48)
    x = x.join(crowded, ["hub", "token"]).withColumn("round", F.floor(F.log2(place + 1)).cast("int")).drop("parts")
    y = y.join(crowded, ["hub", "token"]).withColumn("last", F.floor(F.log2("parts")).cast("int")).drop("parts")
    return files.saved(x, "open"), files.saved(y, "heads")


def late_links(members: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The components after links among members that no hub explains, round by round."""
    x, y = _heads(members)
    size = dict(x.groupBy("round").count().collect()) if files.noted(x) else {}  # a row a round
    n = found.count() if size else 0
    for k in sorted(size):
        some = x.filter(F.col("round") == k)
        label = lambda df, name: df.join(few(found.select(F.col("node").alias(name), F.col("label").alias(f"c_{name}")), 24, n), name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))  # noqa: E731,B023
        fits = (F.col("n_a") * percent <= F.col("n_b") * 100) & (F.col("n_b") * percent <= F.col("n_a") * 100)
        enough = F.least("rest_a", "rest_b") >= F.col("f_a") + F.col("f_b") - F.col("room_a") - _EPS
        asked = y.filter(F.col("last") >= k)  # groups without an open member in this or a later round are through
        pairs = label(asked, "b").join(few(label(some, "a"), 96, size[k]), ["hub", "token"]).filter((F.col("c_a") != F.col("c_b")) & fits & enough)
        pairs = files.saved(pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("hub")).distinct(), "late-pairs")
        if not files.noted(pairs):
            continue
        more = files.saved(_compare(pairs, sets).filter(_linked(percent)).select(F.col("node").alias("a"), F.col("hub").alias("b")), "late")
        if files.noted(more):
            found = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
            n = found.count()
    return found


def link_components(docs: DataFrame, per: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, label: components of the confirmed links between classes; nodes without links are left out."""
    pairs = files.saved(hub_pairs(per), "pairs")
    nodes = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
    wanted = per.select("node", "file", "row").join(few(files.saved(nodes, "nodes"), 16), "node")
    sets = files.saved(_sets(docs, places.mark(wanted.select("file", "row", "node"))), "sets")
    # Each member first meets the hub that it shares most tables with; then those it isn't in one component with.
    best = pairs.groupBy("node").agg(F.max(F.struct("tables", (-F.col("hub")).alias("minus"))).alias("x")).select("node", (-F.col("x.minus")).alias("hub"))
    best = files.saved(best, "best")
    links = _linked_pairs(best, sets, percent)
    found = components(links)
    apart = _apart(pairs.join(few(best, 24), ["node", "hub"], "left_anti"), found)
    more = _linked_pairs(files.saved(apart.select("node", "hub"), "apart"), sets, percent)
    if files.noted(more):
        links = links.union(more)
        found = components(links)
    # Groups that fall into several components have pairs of members that nobody has compared yet.
    several = pairs.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").select("hub")
    unsettled = files.saved(_apart(pairs, found).select("hub").distinct().join(several.hint("merge"), "hub"), "unsettled")
    group = files.saved(pairs.join(few(unsettled, 16), "hub", "left_semi").select("node", "hub"), "unsettled-group")
    members = files.saved(measured(group, sets, percent), "members")
    closest = members.groupBy("hub").agg(F.min(F.struct("f", "node")).alias("m")).select("hub", F.col("m.f").alias("low"), F.col("m.node").alias("mid"))
    members = files.saved(members.join(few(files.saved(closest, "closest"), 24), "hub"), "near")
    star = files.saved(members.filter("node <> mid").select("node", F.col("mid").alias("hub")).distinct(), "mid-pairs")
    star = files.saved(_compare(star, sets).select("node", F.col("hub").alias("mid"), _linked(percent).alias("linked")), "star", linked=F.count_if("linked"))
    near = star.filter("linked").select(F.col("node").alias("a"), F.col("mid").alias("b"))
    found = components(links.union(near)) if files.noted(star, "linked") else found
    apart = star.filter("not linked").select("node", "mid", F.lit(True).alias("open"))
    members = members.join(few(apart, 32), ["node", "mid"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    return late_links(members, sets, found, percent)


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs(node, hub), a written table, whose full sets are similar enough."""
    return files.saved(_compare(pairs, sets).filter(_linked(percent)).select(F.col("node").alias("a"), F.col("hub").alias("b")), "links")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs(node, hub) that are in different components so far."""
    n = found.count()
    label = lambda side, name: few(found.select(F.col("node").alias(side), F.col("label").alias(name)), 24, n)
    both = pairs.join(label("node", "_a"), "node", "left").join(label("hub", "_b"), "hub", "left")
    return both.filter(F.coalesce("_a", "node") != F.coalesce("_b", "hub")).drop("_a", "_b")


def _named(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, named): every document's set key; and per key its class, component and the component's label."""
    rows, per = classes(docs)
    found = link_components(docs, per, percent)
    joined = per.select("node", "rep", "set_key").join(found.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = joined.groupBy("label").agg(F.min("rep").alias("component"))
    named = joined.join(low.hint("merge"), "label").select("set_key", F.col("rep").alias("class_id"), "component", "label")
    return rows, files.saved(named, "components")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: its number of shingles, component and whether it is the one to keep."""
    docs = places.rooted(docs)
    with files.scope(docs.sparkSession):
        rows, named = _named(docs, percent)
        out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(named.hint("merge"), "set_key", "left")
        component = F.coalesce("component", "doc_id")
        out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))
        return files.saved(out, "near-duplicates", keep=True)


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with one row of each component, with the columns they came with.

    Rows are told apart by id and shingles, so rows of one id stay or go each with its own text; of those
    of one id in one component one stays, as of those of one id without words: of texts that are not
    null, the one of the smallest hash, then the first by place.
    """
    docs = places.rooted(docs)
    with files.scope(docs.sparkSession):
        rows, named = _named(docs, percent)
        each = rows.filter("doc_id is not null").select("file", "row", "doc_id", "text_key", "set_key").join(named.hint("merge"), "set_key", "left")
        each = files.saved(each.select("file", "row", "doc_id", "text_key", F.coalesce("label", F.lit(-1)).alias("label"), (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept")), "judged")
        group = ["doc_id", "label"]
        first = F.min(F.struct(F.col("text_key").isNull(), "text_key", "file", "row")).alias("one")
        again = each.filter("kept").groupBy(*group).agg(F.count("*").alias("n"), first).filter("n > 1").select(*group, "one")
        others = each.filter("kept").join(again.hint("merge"), group).filter((F.col("file") != F.col("one.file")) | (F.col("row") != F.col("one.row")))
        gone = each.filter("not kept").select("file", "row").union(others.select("file", "row"))
        folder = places.mark(gone, name="copies", keep=True)

    def run(batch, table, lo, hi):
        stay = batch if table is None else batch.filter(pa.array(hi == lo))
        if stay.num_rows:
            yield stay

    return places.beside(docs, [docs[c] for c in docs.columns], folder, run, docs.schema)
