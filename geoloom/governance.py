"""Gates on reading and releasing data.

A gate runs on the driver before a plan is made: what is denied never becomes a
scan. Every attempt is logged before it is denied."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timezone
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.sizes import small


class AccessDenied(PermissionError):
    """A read or a release that the rules don't permit."""


class Access(IntEnum):
    """Who may see a dataset; higher is tighter."""

    PUBLIC = 0
    COMMUNITY = 1
    RESTRICTED = 2


@dataclass(frozen=True)
class Record:
    """How a dataset is governed."""

    name: str
    tier: Access
    steward: str = ""
    notes: str = ""


def may_access(record: Record, requester: Access) -> bool:
    return requester >= record.tier


def gated(record: Record, requester: Access, payload):
    """The payload, such as a lazy DataFrame, or AccessDenied."""
    if not may_access(record, requester):
        raise AccessDenied(f"{record.name} is {record.tier.name}, the requester {requester.name}")
    return payload


def visible(df: DataFrame, requester: Access, rank: str = "tier_rank") -> DataFrame:
    """The rows that a requester may see: a filter that reaches the scan."""
    return df.where(F.col(rank) <= int(requester))


class Tier(IntEnum):
    """Detail of released data; higher is finer and tighter."""

    PUBLIC = 0
    PARTNER = 1
    COMMUNITY = 2
    RESTRICTED = 3


TIER_RULES: dict[Tier, dict[str, str]] = {
    Tier.PUBLIC: {"detail": "region mean", "needs": "nothing"},
    Tier.PARTNER: {"detail": "blocks of cells", "needs": "a current agreement"},
    Tier.COMMUNITY: {"detail": "cells", "needs": "a current agreement that names the dataset"},
    Tier.RESTRICTED: {"detail": "none leaves", "needs": "is never granted here"},
}


def tier_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, int(t), r["detail"], r["needs"]) for t, r in TIER_RULES.items()], "tier string, tier_rank int, detail string, needs string")


@dataclass(frozen=True)
class Agreement:
    """What a nation has agreed to share, with whom and until when."""

    nation: str
    counterparty: str
    purpose: str
    executed: date
    expires: date
    release_authority: str
    tiers: tuple[Tier, ...]
    scope: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("nation", "counterparty", "purpose", "release_authority"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} is empty")
        if not self.tiers:
            raise ValueError("an agreement needs a tier")
        if self.expires < self.executed:
            raise ValueError("the agreement ends before it begins")

    def current(self, on: date | None = None) -> bool:
        return self.executed <= (on or date.today()) <= self.expires

    def days_left(self, on: date | None = None) -> int:
        return (self.expires - (on or date.today())).days

    def permits(self, tier: Tier, dataset: str, on: date | None = None) -> bool:
        return self.current(on) and tier in self.tiers and (not self.scope or dataset in self.scope)

    def summary(self) -> str:
        tiers = ", ".join(t.name for t in self.tiers)
        return f"{self.nation} with {self.counterparty}: {self.purpose}; {tiers}; {self.executed} to {self.expires}; released by {self.release_authority}"


@dataclass
class Gatekeeper:
    """Checks access under an agreement and keeps a log."""

    nation: str
    agreement: Agreement | None = None
    log: list[tuple[str, str, str, str, str]] = field(default_factory=list)

    def _note(self, tier: Tier, dataset: str, action: str, result: str) -> None:
        self.log.append((datetime.now(timezone.utc).isoformat(timespec="seconds"), tier.name, dataset, action, result))

    def check(self, tier: Tier, dataset: str, action: str = "read", on: date | None = None) -> None:
        if tier == Tier.RESTRICTED:
            why = "restricted data are never read"
        elif tier == Tier.PUBLIC:
            why = ""
        elif self.agreement is None:
            why = "there is no agreement"
        elif not self.agreement.current(on):
            why = "the agreement isn't current"
        elif not self.agreement.permits(tier, dataset, on):
            why = "the agreement doesn't cover it"
        else:
            why = ""
        self._note(tier, dataset, action, f"denied: {why}" if why else "permitted")
        if why:
            raise AccessDenied(f"{dataset} ({tier.name}): {why}")

    def most(self, on: date | None = None) -> Tier:
        """The finest tier that may be read."""
        if self.agreement is None or not self.agreement.current(on):
            return Tier.PUBLIC
        return max([Tier.PUBLIC, *[t for t in self.agreement.tiers if t != Tier.RESTRICTED]])

    def check_publication(self, approved: bool, record: str | None) -> None:
        """Release needs an approval and the record of it."""
        if not approved or not record:
            raise AccessDenied("publication needs an approval and its record")

    def load(self, spark: SparkSession, path: str, dataset: str, tier: Tier, read: Callable[[SparkSession, str], DataFrame] | None = None, on: date | None = None) -> DataFrame:
        """Gate, then read, then scan for what must not be shared."""
        self.check(tier, dataset, on=on)
        df = read(spark, path) if read else spark.read.parquet(path)
        guard(df)
        return df

    def audit(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "when string, tier string, dataset string, action string, result string")


HINTS = ("burial", "ceremon", "cemeter", "sacred", "archaeolog", "petroglyph", "gathering", "medicine plant", "shrine", "ancestral")
GUARD_DISTINCT = 200


def suspicious(df: DataFrame, hints: Iterable[str] = HINTS) -> list[str]:
    """Column names and values with a hint of a cultural site, sorted. Values
    are looked at in text columns of at most 200 distinct ones; one aggregate."""
    hints = tuple(hints)
    found = {c for c in df.columns if any(h in c.lower().replace("_", " ") or h in c.lower() for h in hints)}
    texts = [c for c, k in df.dtypes if k == "string"]
    if texts:
        few = df.agg(*[F.count_distinct(c).alias(c) for c in texts]).first()
        few = [c for c in texts if 0 < few[c] <= GUARD_DISTINCT]
        if few:
            pattern = "|".join(hints)
            row = df.agg(*[F.collect_set(F.when(F.lower(c).rlike(pattern), F.col(c))).alias(c) for c in few]).first()
            found |= {f"{c}={v}" for c in few for v in row[c]}
    return sorted(found)


def guard(df: DataFrame, hints: Iterable[str] = HINTS) -> DataFrame:
    """df, unless `suspicious` finds something. A text column of more than 200
    distinct values isn't looked into: a name in free text passes."""
    if found := suspicious(df, hints):
        raise AccessDenied(f"the data seem to tell of cultural sites: {found}")
    return df


def at_tier(df: DataFrame, tier: Tier, values: Iterable[str], y: str = "y", x: str = "x") -> DataFrame:
    """Cells at the detail of a tier: the mean, blocks of 4 x 4, or refusal."""
    from geoloom.operators.zonal import coarsened

    values = list(values)
    if tier == Tier.PUBLIC:
        return df.agg(*[F.avg(v).alias(v) for v in values])
    if tier == Tier.PARTNER:
        return coarsened(df, 4, "avg", values, y, x)
    raise AccessDenied(f"{tier.name} data aren't released")


#: Questions by principle of the CARE framework.
CARE = {
    "Collective benefit": ("Does the work serve needs the community has named?", "Do results come back in a form it can use?"),
    "Authority to control": ("Was the work agreed to beforehand?", "Can consent be taken back?", "Does the community decide on release?"),
    "Responsibility": ("Are relations kept up after the work?", "Is local capacity built?"),
    "Ethics": ("Are harms looked at from the community's view?", "Is later use limited?"),
}


def care_assessment(spark: SparkSession, answers: Mapping[str, bool | None]) -> DataFrame:
    """(principle, questions, met, unaddressed) and the same over all as
    principle NULL; an unanswered question counts as unmet."""
    questions = spark.createDataFrame([(p, q) for p, qs in CARE.items() for q in qs], "principle string, question string")
    given = spark.createDataFrame([(q, a) for q, a in answers.items()] or [], "question string, answer boolean")
    joined = questions.join(small(given), "question", "left")
    return joined.rollup("principle").agg(F.count("*").alias("questions"), F.count_if("answer").alias("met"), F.count_if(F.col("answer").isNull()).alias("unaddressed"))


def care_unmatched(answers: Mapping[str, bool | None]) -> list[str]:
    """Answers to questions that aren't asked."""
    return sorted(set(answers) - {q for qs in CARE.values() for q in qs})


@dataclass(frozen=True)
class Provenance:
    """Where a result comes from."""

    title: str
    sources: tuple[str, ...]
    steps: tuple[str, ...] = ()
    parameters: Mapping[str, object] = field(default_factory=dict)
    authority: str = ""

    def fingerprint(self) -> str:
        plain = {k: str(v) for k, v in asdict(self).items()}
        return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:16]

    def markdown(self) -> str:
        lines = [f"# {self.title}", "", f"Fingerprint: `{self.fingerprint()}`", "", "## Sources", *[f"- {s}" for s in self.sources]]
        if self.steps:
            lines += ["", "## Steps", *[f"{i}. {s}" for i, s in enumerate(self.steps, 1)]]
        if self.parameters:
            lines += ["", "## Parameters", *[f"- {k}: {v}" for k, v in sorted(self.parameters.items())]]
        return "\n".join([*lines, "", f"Release authority: {self.authority or 'none named'}", ""])


def acknowledgment(nation: str, authority: str, on: date | None = None) -> str:
    return f"These data concern lands and peoples of {nation}. Authority over them rests with {authority}, not with whoever holds a copy ({on or date.today()})."


def masking_note() -> str:
    return "Masking a place is not enough: the mask's outline, gaps in a grid and repeated releases can all give the place away; what may be told is for the community to say."


def two_framings(vulnerability, capacity):
    """A text column that gives a vulnerability score and a capacity index side
    by side; NULL where either is missing."""
    text = F.format_string("vulnerability %.2f and capacity %.2f; one is not the opposite of the other, and either alone misleads", F.col(vulnerability).cast("double"), F.col(capacity).cast("double"))
    return F.when(F.col(vulnerability).isNotNull() & F.col(capacity).isNotNull(), text)


def ocap_note() -> str:
    """How to cite the OCAP principles."""
    return "OCAP (ownership, control, access, possession) is a registered trademark of the First Nations Information Governance Centre. A nation's own codes and review come first; none should be taken to have adopted it."
