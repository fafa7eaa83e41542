"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import free_name, identified, stored
from pagemill.llm.line_dedup import let
from pagemill.operators.scale import is_small, join_dimension, row_numbers

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
FAN_IN = 128
HEAVY = 1024
SEED = 11

_EDGE = 1e-9
_MEMBER = "struct<doc_id: bigint, size: bigint, mass: double>"
_DECIDED = "array<struct<doc_id: bigint, up: boolean>>"


def uniform(*parts: Column) -> Column:
    """A number from [0, 1) that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") * F.lit(2.0**-53)


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``k, key, source_size, target`` of each source of ``key, source, size`` rows.

    Sources are numbered by code point, null last, and take the weights in turn.
    ``share`` times all sizes are dealt by weight; a target stops at ``cap``
    times its source's size and the excess goes to the others by weight, round
    after round. Only two sums of a round reach the driver.
    """
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")).withColumn("no_source", F.col("source").isNull())
    numbered = row_numbers(sources, [], ["no_source", "source"], "k")
    in_turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(numbered.select("k", "key", "source_size", in_turn.cast("double").alias("weight")))
    ceiling, level = F.lit(float(cap)) * F.col("source_size"), None
    everything = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        stopped = F.lit(False) if level is None else F.lit(level) * F.col("weight") > ceiling
        at_cap, free = table.agg(F.sum(F.when(stopped, ceiling).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        following = (everything - at_cap) / free if free else level
        if following == level:
            break
        level = following
    return table.select("k", "key", "source_size", F.least(F.lit(level).cast("double") * F.col("weight"), ceiling).alias("target"))


def _whole(size: Column, mass: Column) -> Column:
    """1 or 0 where all or none of a document's words are taken, null in between."""
    return F.when(mass >= size * (1 - _EDGE), F.lit(1)).when(mass <= size * _EDGE, F.lit(0))


def _moved(size: Column, mass: Column, other_size: Column, other_mass: Column, chance: Column) -> Column:
    """Words that go from the other to the first, negative for the other way: enough to settle one of them.

    The chance of each way is in proportion to the other way's amount, so that
    the expected mass of both stays.
    """
    gain, loss = F.least(size - mass, other_mass), F.least(mass, other_size - other_mass)
    return F.when(chance * (gain + loss) < loss, gain).otherwise(-loss)


def _settle_heavy(members: Column, total: Column, mass: Column) -> Column:
    """Pair large documents, the largest first, each with all that come after it.

    ``members`` are (-size, doc_id); ``total`` and ``mass`` are the words of the
    source and those to take. Returns the words and the mass of what is left,
    the settled documents, and those that could not be.
    """
    start = F.struct(total.cast("double").alias("total"), mass.alias("mass"), F.array().cast(_DECIDED).alias("decided"), F.array().cast(f"array<{_MEMBER}>").alias("open"))

    def step(state: Column, member: Column) -> Column:
        size, doc_id = -member["minus"], member["doc_id"]

        def with_own(own: Column) -> Column:
            rest = F.greatest(state["total"] - size, F.lit(0.0))
            rest_mass = F.least(F.greatest(state["mass"] - own, F.lit(0.0)), rest)

            def with_move(moved: Column) -> Column:
                whole = _whole(size, own + moved)
                return F.struct(
                    rest.alias("total"),
                    F.least(F.greatest(rest_mass - moved, F.lit(0.0)), rest).alias("mass"),
                    F.concat(state["decided"], F.when(whole.isNotNull(), F.array(F.struct(doc_id.alias("doc_id"), (whole == 1).alias("up")))).otherwise(F.array().cast(_DECIDED))).alias("decided"),
                    F.concat(state["open"], F.when(whole.isNull(), F.array(F.struct(doc_id.alias("doc_id"), size.alias("size"), (own + moved).alias("mass")))).otherwise(F.array().cast(f"array<{_MEMBER}>"))).alias("open"),
                )

            return let(_moved(size, own, rest, rest_mass, uniform(doc_id)), with_move)

        return let(F.least(state["mass"] / state["total"], F.lit(1.0)) * size, with_own)

    return F.aggregate(members, start, step)


def _settle_pairs(members: Column) -> Column:
    """Pair documents one after another, the largest first; the open one of each pair meets the next.

    ``members`` are (-size, doc_id, mass). Returns the settled documents and the open one, if any.
    """
    start = F.struct(F.lit(None).cast(_MEMBER).alias("open"), F.array().cast(_DECIDED).alias("decided"))

    def step(state: Column, member: Column) -> Column:
        a, size, mass, doc_id = state["open"], -member["minus"], member["mass"], member["doc_id"]

        def with_move(moved: Column) -> Column:
            first, second = _whole(a["size"], a["mass"] + moved), _whole(size, mass - moved)
            marks = F.array(F.struct(a["doc_id"].alias("doc_id"), (first == 1).alias("up")), F.struct(doc_id.alias("doc_id"), (second == 1).alias("up")))
            still_a = F.struct(a["doc_id"].alias("doc_id"), a["size"].alias("size"), (a["mass"] + moved).alias("mass"))
            still_b = F.struct(doc_id.alias("doc_id"), size.alias("size"), (mass - moved).alias("mass"))
            return F.struct(
                F.when(first.isNull(), still_a).when(second.isNull(), still_b).alias("open"),
                F.concat(state["decided"], F.filter(marks, lambda mark: mark["up"].isNotNull())).alias("decided"),
            )

        alone = F.struct(F.struct(doc_id.alias("doc_id"), size.alias("size"), mass.alias("mass")).alias("open"), state["decided"].alias("decided"))
        return F.when(a.isNull(), alone).otherwise(let(_moved(a["size"], a["mass"], size, mass, uniform(a["doc_id"], doc_id)), with_move))

    return F.aggregate(members, start, step)


def _reduce(members: DataFrame, fan_in: int) -> DataFrame:
    """``doc_id, up`` of all members ``k, n, doc_id, size, mass``, settled in a tree of groups.

    A level deals each source's members to groups of about ``fan_in`` by a hash
    of the id; a group leaves at most one open member to the next level, so ``n``
    falls to the number of groups. The last one of a source is taken with the
    chance its mass gives.
    """
    decided, level = [], 0
    most = members.agg(F.max("n")).first()[0] or 0
    while most > 1:
        groups = F.ceil(F.col("n") / fan_in).cast("long")
        dealt = members.withColumns({"groups": groups, "g": F.pmod(F.xxhash64(F.lit(level), "doc_id"), groups)})
        member = F.struct((-F.col("size")).alias("minus"), "doc_id", "mass")
        settled = dealt.groupBy("k", "g").agg(F.first("groups").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))
        table = stored(settled.select("k", "n", _settle_pairs(F.col("members")).alias("state")).select("k", "n", "state.*"))
        decided.append(table.select(F.explode("decided").alias("d")).select("d.doc_id", "d.up"))
        members = table.filter("open IS NOT NULL").select("k", "n", "open.*")
        most, level = -(-most // fan_in), level + 1
    result = members.select("doc_id", (uniform(F.col("doc_id"), F.lit("last")) * F.col("size") < F.col("mass")).alias("up"))
    for part in decided:
        result = result.union(part)
    return result


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, fan_in: int = FAN_IN, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``: how often the mix takes each document.

    The size is the number of words. Every document of a source is due
    target / source_size copies: the whole part is given, the fraction is a copy
    probability settled by pivotal rounding. Two documents exchange words until
    one of them is taken whole or not at all, the direction drawn so that the
    expected copies stay, and the words of a source keep their sum. Documents
    with over 1/``heavy`` of their source's words (fewer than ``heavy`` a source) are
    paired first, each with the whole rest of the source; the others meet in a
    reduction tree. So a source misses its target by less than the words of one
    document, as a rule a small one. Draws depend on the ids only: reruns agree.

    A null or empty text has size 0 and one copy less or more does not matter:
    it gets the whole part. A null source is a source of its own, the last.
    Rows without doc_id are left out; of rows that repeat an id the one with
    the least source and size counts. Other columns are ignored, an empty table
    gives no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = identified(stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size)))
    keyed = sized.withColumn("key", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))
    targets = stored(source_targets(keyed, weights, share, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + _EDGE)
    fraction = F.greatest(rate - whole, F.lit(0.0))
    targets = stored(targets.withColumns({"whole": whole.cast("long"), "part": F.when(fraction > _EDGE, fraction).otherwise(0.0)}))
    few = is_small(targets)
    joined = stored(join_dimension(keyed.drop("source"), targets, ["key"], ["doc_id"], small=few).drop("key"))

    due = joined.filter("part > 0 AND size > 0")
    is_heavy = F.col("size") * heavy > F.col("source_size")
    large = due.filter(is_heavy).groupBy("k").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("minus"), "doc_id"))).alias("members"), F.first("source_size").alias("total"), F.first("part").alias("part"))
    first = stored(large.select("k", _settle_heavy(F.col("members"), F.col("total"), F.col("total") * F.col("part")).alias("state")).select("k", "state.*"))
    chance = F.when(F.col("total") > 0, F.col("mass") / F.col("total")).otherwise(0.0)
    light = due.filter(~is_heavy)
    small = light.groupBy("k").agg(F.count("*").alias("n"))
    sources = stored(small.join(first.select("k", chance.alias("chance")), "k", "left"))
    light = join_dimension(light, sources, ["k"], ["doc_id"], small=few).select("k", "n", "doc_id", "size", (F.coalesce("chance", "part") * F.col("size")).alias("mass"))
    still = first.select("k", F.lit(1).cast("long").alias("n"), F.explode("open").alias("o")).select("k", "n", "o.*")
    settled = _reduce(stored(light.union(still)), fan_in).union(first.select(F.explode("decided").alias("d")).select("d.doc_id", "d.up"))

    copies = F.col("whole") + F.coalesce(F.col("up").cast("long"), F.lit(0))
    return joined.join(settled, "doc_id", "left").select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: every document as often as ``mix`` takes it, all columns kept.

    Rows without doc_id are left out, rows repeating one are one document.
    """
    unique, copies, key = identified(docs), free_name(docs, "_copies"), free_name(docs, "_doc_id")
    taken = mix(unique, **parameters).filter("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias(copies))
    repeated = unique.join(taken, F.col("doc_id") == F.col(key)).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return repeated.select(*[F.col(f"`{name}`") for name in docs.columns])
