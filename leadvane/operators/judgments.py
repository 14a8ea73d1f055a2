"""Lead cards, request keys and the contract, encoding and caching of per-lead judgments."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import (CONTEXT_LEVELS, CONTEXT_REFERENCES, JUDGMENTS, PERSONA_GROUPS, REASON_MAX_WORDS,
                             STAMP_COLUMNS)
from leadvane.functions.scores import logit
from leadvane.functions.text import strip, text_or_null, word_count
from leadvane.operators.crm import map_lookup
from leadvane.operators.quality import require_unique

# fixed values: card labels and the blank marker
BLANK = "(blank)"
CARD_LABELS = {"what_to_solve": "What they want to solve", "company_typed": "Company typed", "job_title": "Job title",
               "email_domain": "Email domain"}


def card_fields(what: Column, companies: Sequence[Column], title: Column, email: Column) -> dict[str, Column]:
    """The four card strings; the domain is the part after the last ``@``."""
    blank = F.lit(BLANK)
    domain = F.when(F.coalesce(email.contains("@"), F.lit(False)), F.lower(F.substring_index(strip(email), "@", -1)))
    return {"what_to_solve": F.coalesce(text_or_null(what), blank),
            "company_typed": F.coalesce(*[text_or_null(c) for c in companies], blank),
            "job_title": F.coalesce(text_or_null(title), blank), "email_domain": F.coalesce(domain, blank)}


def card_text(fields: dict[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{CARD_LABELS[k]}: "), fields[k]) for k in CARD_LABELS])


def card_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(card_text(fields), 256)


def cache_key(parts: Sequence[Column]) -> Column:
    """SHA-256 of the identifiers as a JSON list."""
    quoted = [F.concat(F.lit('"'), p.cast("string"), F.lit('"')) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256)


def split_requests(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows answered by the cache, one row per distinct missing key)."""
    known = cache.select(key).distinct()
    hits = requests.join(known, key, "left_semi")
    misses = requests.join(known, key, "left_anti").dropDuplicates([key])
    return hits, misses


def contract_problems(df: DataFrame, key: str = "lead_id") -> DataFrame:
    """Violations of ok rows: a judgment outside its list, a blank reason, a reason with too many words."""
    checks = [F.when(~F.coalesce(F.col(j).isin(*allowed), F.lit(False)), F.struct(
        F.lit(j).alias("column"), F.coalesce(F.col(j), F.lit("<null>")).alias("value"))) for j, allowed in JUDGMENTS.items()]
    words = word_count(F.col("reason"))
    checks.append(F.when((words == 0) | (words > REASON_MAX_WORDS), F.struct(
        F.lit("reason").alias("column"), F.concat(words.cast("string"), F.lit(" words")).alias("value"))))
    bad = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return df.where("status = 'ok'").select(key, F.explode(bad).alias("v")).select(key, "v.*")


def stamps(df: DataFrame) -> DataFrame:
    return df.select(*STAMP_COLUMNS).distinct()


def require_one_stamp(df: DataFrame) -> None:
    found = stamps(df).limit(2).count()
    if found != 1:
        raise ValueError("judgments of different briefs, prompts or models cannot share one set of weights"
                         if found else "no judgment rows")


def judgment_features(df: DataFrame) -> DataFrame:
    """``ctx_`` feature columns of ok rows; the persona is pooled into three groups. A judgment outside its list fails the job."""
    def listed(j: str) -> Column:
        refuse = F.raise_error(F.concat(F.lit(f"judgment {j} is not in its list: "), F.coalesce(F.col(j), F.lit("<null>"))))
        return F.when(F.col(j).isin(*JUDGMENTS[j]), F.col(j)).otherwise(refuse.cast("string"))
    return df.where("status = 'ok'").select(
        "lead_id", map_lookup(PERSONA_GROUPS, listed("persona")).alias("ctx_persona_group"),
        *[listed(j).alias(f"ctx_{j}") for j in JUDGMENTS if j != "persona"])


def context_design(leads: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgment dummies of every lead; all null without an ok judgment. Refuses repeated leads and several stamps."""
    require_unique(judgments, "lead_id", "judgments")
    require_one_stamp(judgments)
    joined = leads.select("lead_id").join(judgment_features(judgments), "lead_id", "left")
    cols = [F.when(F.col(f).isNull(), None).otherwise((F.col(f) == lvl).cast("double")).alias(f"{f}={lvl}")
            for f, ref in CONTEXT_REFERENCES.items() for lvl in CONTEXT_LEVELS[f] if lvl != ref]
    return joined.select("lead_id", *cols)


def context_columns(df: DataFrame, leads: DataFrame) -> DataFrame:
    """Context features from either format, told apart by the columns: a 0-1 score or judgments."""
    if "context_score" in df.columns:
        return leads.select("lead_id").join(df.select("lead_id", logit(F.col("context_score")).alias("context_logit")), "lead_id", "left")
    needed = {"lead_id", "status", *JUDGMENTS, *STAMP_COLUMNS}
    if needed <= set(df.columns):
        return context_design(leads, df)
    raise ValueError(f"neither a score table nor a judgments table: columns {df.columns}")
