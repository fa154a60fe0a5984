"""Bringing the two samples of a pair together."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genopair.functions.encode import dosage_code
from genopair.operators.lookup import lookup_join

# What identifies a variant in every long table.
VARIANT = ["chrom", "pos", "snp", "variant_idx"]


def complete_pairs(samples: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups of exactly two samples, one donor and one recipient.

    One row per group: ``case_id, did, rid`` and the group label. Counting and picking the
    two ids happen in one map-side combined aggregate.
    """
    donor, recipient = F.col("subject_type") == "D", F.col("subject_type") == "R"
    return (
        samples.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(donor).alias("_nd"),
            F.count_if(recipient).alias("_nr"),
            F.max(F.when(donor, F.col("seq_id"))).alias("did"),
            F.max(F.when(recipient, F.col("seq_id"))).alias("rid"),
            F.min("group").alias("group"),
        )
        .filter((F.col("_n") == 2) & (F.col("_nd") == 1) & (F.col("_nr") == 1))
        .select(F.col(group).alias("case_id"), "did", "rid", "group")
    )


def samples_in_complete_pairs(samples: DataFrame, group: str = "group_id") -> DataFrame:
    """The sample rows that belong to groups of exactly two samples."""
    sized = samples.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 2)
    return lookup_join(samples, sized.select(group), [group], "left_semi")


def group_sizes(samples: DataFrame, group: str = "group_id") -> DataFrame:
    return samples.groupBy(group).agg(F.count(F.lit(1)).alias("n_samples"))


def pair_roles(pairs: DataFrame) -> DataFrame:
    """One row per (sample, case): ``sample_id, case_id, role``."""
    both = F.array(
        F.struct(F.col("did").alias("sample_id"), F.lit("D").alias("role")),
        F.struct(F.col("rid").alias("sample_id"), F.lit("R").alias("role")),
    )
    return pairs.select("case_id", F.explode(both).alias("s")).select("s.sample_id", "case_id", "s.role")


def pair_calls(calls: DataFrame, pairs: DataFrame, values: tuple = ("dosage",), keys: list = VARIANT) -> DataFrame:
    """Donor and recipient values of every pair side by side: ``d_<value>, r_<value>``.

    Each call meets the (sample, pair, role) list once and one combined aggregate folds
    the two roles together, instead of joining the calls with themselves. Roles are
    explicit, so the sign of a directed code never depends on file order. A pair that
    lacks one sample keeps its row with NULLs on that side, one that lacks both has none;
    a case with two pairs has a row for each.
    """
    both = F.array(*[F.struct(F.col(c).alias("sample_id"), F.lit(role).alias("role")) for c, role in (("did", "D"), ("rid", "R"))])
    roles = pairs.select("case_id", F.struct("did", "rid").alias("_pair"), F.explode(both).alias("s"))
    roles = roles.select("s.sample_id", "case_id", F.xxhash64("_pair").alias("_pair"), "s.role")
    tagged = lookup_join(calls.select(*keys, "sample_id", *values), roles, ["sample_id"])
    sides = [
        F.max(F.when(F.col("role") == role, F.col(v))).alias(f"{prefix}_{v}")
        for role, prefix in (("D", "d"), ("R", "r"))
        for v in values
    ]
    return tagged.groupBy(*keys, "case_id", "_pair").agg(*sides).drop("_pair")


def encode_pairs(paired: DataFrame, mode: str, keys: list = VARIANT) -> DataFrame:
    """Long encoded matrix for one dosage mode: variant, ``case_id``, ``code``."""
    return paired.select(*keys, "case_id", dosage_code(mode).alias("code"))


def encode_modes(paired: DataFrame, modes: tuple, keys: list = VARIANT) -> DataFrame:
    """Several dosage modes at once: one scan and one pairing, then one row per mode."""
    coded = F.array(*[F.struct(F.lit(m).alias("mode"), dosage_code(m).alias("code")) for m in modes])
    return paired.select(*keys, "case_id", F.explode(coded).alias("e")).select(*keys, "case_id", "e.mode", "e.code")


def recipient_calls(calls: DataFrame, cases: DataFrame, keys: list = VARIANT) -> DataFrame:
    """The recipient's own dosage per case: variant, ``case_id``, ``code``."""
    wanted = cases.select(F.col("rid").alias("sample_id"), "case_id")
    return lookup_join(calls.select(*keys, "sample_id", "dosage"), wanted, ["sample_id"]).select(
        *keys, "case_id", F.col("dosage").alias("code")
    )


def outcome_of_case(outcomes: DataFrame, columns: list, key: str = "case_id") -> DataFrame:
    """One whole row of the outcome table per case, never a mix of several.

    It is the first in file order where the table has it (``file_order``, from ``read_outcomes``),
    else the smallest by the columns' values.
    """
    row = F.struct(*columns)
    first = F.min_by(row, F.col("file_order")) if "file_order" in outcomes.columns else F.min(row)
    picked = outcomes.groupBy(key).agg(first.alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def with_outcome(encoded: DataFrame, outcomes: DataFrame, columns: list, key: str = "case_id") -> DataFrame:
    """Attach outcome columns by case. The outcome table is reduced to one row per case first."""
    single = outcome_of_case(outcomes, columns, key)
    return lookup_join(encoded, single, [key], "left")


def case_control(samples: DataFrame, group: str = "group_id") -> DataFrame:
    """``case_id, status``: 'case' for label 'a', 'control' for 'n'; other labels drop out."""
    return (
        samples.groupBy(F.col(group).alias("case_id"))
        .agg(F.min("group").alias("group"))
        .filter(F.col("group").isin("a", "n"))
        .select("case_id", F.when(F.col("group") == "a", "case").otherwise("control").alias("status"))
    )


def check_pairs(pairs: DataFrame, roster: DataFrame) -> DataFrame:
    """Integrity of a pair table against a sample roster: one row per finding.

    ``not_in_roster`` and ``not_in_pairs`` are ids known to one side only;
    ``extra_in_pairs`` and ``extra_in_roster`` are what remains of either id list after
    taking away the other, copies counted; ``self_pair`` is a donor paired with itself.
    """
    paired = pair_roles(pairs.select("case_id", "did", "rid")).select("sample_id")
    listed = roster.select("sample_id")

    n_pairs = paired.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    n_roster = listed.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_roster"))
    # one row per id on either side, so a repeated id costs nothing in the join
    both = n_pairs.join(n_roster, "sample_id", "full").fillna(0, ["n_pairs", "n_roster"])
    gap = F.col("n_pairs") - F.col("n_roster")

    def finding(condition: Column, name: str, n: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("finding"), n.alias("n")))

    found = F.filter(
        F.array(
            finding(F.col("n_roster") == 0, "not_in_roster", F.col("n_pairs")),
            finding(F.col("n_pairs") == 0, "not_in_pairs", F.col("n_roster")),
            finding(gap > 0, "extra_in_pairs", gap),
            finding(gap < 0, "extra_in_roster", -gap),
        ),
        lambda f: f.isNotNull(),
    )
    findings = both.select("sample_id", F.explode(found).alias("f")).select("sample_id", "f.finding", "f.n")
    same = (
        pairs.filter(F.col("did") == F.col("rid"))
        .groupBy(F.col("did").alias("sample_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("sample_id", F.lit("self_pair").alias("finding"), "n")
    )
    return findings.unionByName(same)
