"""Transforms of flows: merging and routing sources, filling fields, labelling by profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_sources(flows: DataFrame, mapping: dict[int, int], default: int | None = None) -> DataFrame:
    """Give flows of some domains the id of another, and keep the first id in e0id405 where it isn't set."""
    known = F.col("e0id405") if "e0id405" in flows.columns else F.lit(None).cast("long")
    out = flows.withColumn("e0id405", F.coalesce(known, F.col("odid")))
    table = F.create_map(*(F.lit(x).cast("long") for pair in mapping.items() for x in pair))
    return out.withColumn("odid", F.coalesce(F.try_element_at(table, F.col("odid")), F.lit(default).cast("long"), F.col("odid")))


def route(flows: DataFrame, rules: list[tuple[list[int], Column, int]], keep: bool = False) -> DataFrame:
    """Copies of the flows that meet a rule (domains, predicate, domain to send to); a flow may meet several.

    Flows of a domain no rule names pass unchanged; the others' originals stay only if keep is set.
    One pass: each flow gets the list of its destinations, which is exploded.
    """
    named = sorted({d for domains, _, _ in rules for d in domains})
    to = [F.when(F.col("odid").isin(*domains) & predicate, F.lit(target).cast("long")) for domains, predicate, target in rules]
    own = F.when(F.lit(keep) | ~F.col("odid").isin(*named), F.col("odid"))
    return flows.withColumn("odid", F.explode(F.array_compact(F.array(own, *to))))


def fill_exporter(flows: DataFrame, address: Column) -> DataFrame:
    known = F.col("e0id403") if "e0id403" in flows.columns else F.lit(None).cast("long")
    return flows.withColumn("e0id403", F.coalesce(known, address))


def shift_to_now(flows: DataFrame, exported: Column, now: Column) -> DataFrame:
    """Move start and end by the time since the export (both in seconds), where both are present."""
    both = F.col("e0id152").isNotNull() & F.col("e0id153").isNotNull()
    by = (now - exported) * 1000
    return flows.withColumns({c: F.when(both, F.col(c) + by).otherwise(F.col(c)) for c in ("e0id152", "e0id153")})


def in_future(now_ms: int, tolerance_ms: int = 24 * 3600 * 1000) -> Column:
    late = F.lit(now_ms + tolerance_ms)
    return F.coalesce(F.col("e0id152") > late, F.lit(False)) | F.coalesce(F.col("e0id153") > late, F.lit(False))


@dataclass
class Channel:
    """A named predicate (None: all flows) on what its sources, channels of the parent profile, let through."""

    name: str
    predicate: Column | None = None
    sources: tuple[str, ...] = ("*",)


@dataclass
class Profile:
    name: str
    channels: list[Channel]
    profiles: list[Profile] = field(default_factory=list)


def labels(profile: Profile, path: str = "", parents: dict[str, Column] | None = None) -> list[tuple[str, str, Column]]:
    """(profile path, channel, predicate) of the whole tree."""
    path, out, own = f"{path}/{profile.name}".lstrip("/"), [], {}
    for c in profile.channels:
        unknown = set(c.sources) - {"*"} - set(parents or {})
        if parents is not None and unknown:
            raise ValueError(f"{path}: no such source {sorted(unknown)}")
        met = F.lit(True) if c.predicate is None else c.predicate
        if parents is not None:
            used = [p for n, p in parents.items() if "*" in c.sources or n in c.sources]
            passed = F.lit(False)  # a parent without channels lets nothing through
            for p in used:
                passed = passed | p
            met = met & passed
        own[c.name] = met
        out.append((path, c.name, met))
    for p in profile.profiles:
        out += labels(p, path, own)
    return out


def classify(flows: DataFrame, profile: Profile) -> DataFrame:
    """flows with channels: every (profile, channel) that a flow reaches, once each."""
    each = [F.when(met, F.struct(F.lit(p).alias("profile"), F.lit(c).alias("channel"))) for p, c, met in labels(profile)]
    return flows.withColumn("channels", F.array_compact(F.array(*each)))
