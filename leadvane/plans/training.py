"""Train-and-score and batch-scoring plans over the lead, CRM and company tables."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.config import LEVELS, V2_REFERENCES, VALUE_LEVELS, LabelSpec, RunDates, design_columns
from leadvane.functions.scores import linear_score, sigmoid
from leadvane.operators import cleaning, crm, design, enrichment, extras, features, fits, labels, models, value
from leadvane.schemas import LEADS

VALUE_COLUMNS = design_columns(dict.fromkeys(VALUE_LEVELS), VALUE_LEVELS)
#: What ``train`` reads of prepared rows, without extras; ``label_source`` refuses leads without a recognised final stage.
TRAINING_COLUMNS = ("lead_id", "label_source", "y", "deal_value", "is_train", *dict.fromkeys([*V2_REFERENCES, *VALUE_LEVELS]))


@dataclass(frozen=True)
class FittedModel:
    """Everything scoring needs: weights, value model, transform and frozen extra encodings."""

    win: dict[str, float]
    deal: models.ValueModel
    transform: value.FittedTransform
    encoder: tuple[extras.FittedExtra, ...] = ()
    margin: float = 1.0


def prepare(leads: DataFrame, crm_events: DataFrame, companies: DataFrame, spec: LabelSpec, dates: RunDates) -> DataFrame:
    """Leads to labelled, featurised rows with split masks: one lazy plan."""
    leads = enrichment.with_answers(leads)
    cleaned = crm.add_crm_outcomes(cleaning.clean(leads), crm_events)
    enriched = enrichment.enrich(labels.assign_labels(cleaned, spec, dates), companies, keyed=leads)
    return labels.with_split(features.v2_features(enriched), spec, dates)


def train(rows: DataFrame, margin: float = 1.0, transform: value.ValueTransform = value.ValueTransform(),
          encoder: tuple[extras.FittedExtra, ...] = ()) -> FittedModel:
    """Fits the win and value models and the transform on the training rows (persist ``rows`` first)."""
    refs, levels = {**V2_REFERENCES, **extras.references(encoder)}, {**LEVELS, **extras.levels(encoder)}
    columns = design_columns(refs, levels)
    train_rows = rows.where("is_train")
    wide = design.wide_design(train_rows, refs, levels, keep=["y"])
    win = fits.fit_one(wide, columns)  # a handful of passes over the training rows
    won = train_rows.where("y = 1 and deal_value is not null")
    deal = models.fit_deal_value(design.wide_design(won, dict.fromkeys(VALUE_LEVELS), VALUE_LEVELS, keep=["deal_value"]), VALUE_COLUMNS)
    scored = with_scores(train_rows, win, deal, margin)
    return FittedModel(win, deal, value.fit_transform(scored, "value_formula", transform), encoder, margin)


def with_scores(rows: DataFrame, win: dict[str, float], deal: models.ValueModel, margin: float) -> DataFrame:
    """Adds ``p_formula``, ``deal_value_hat`` and ``value_formula``."""
    scored = rows.withColumns({"p_formula": sigmoid(linear_score(win)),
                               "deal_value_hat": F.exp(linear_score(deal.weights)) * F.lit(deal.correction)})
    return scored.withColumn("value_formula", F.col("p_formula") * F.col("deal_value_hat") * F.lit(margin))


def score_rows(rows: DataFrame, model: FittedModel, spec: LabelSpec, dates: RunDates) -> DataFrame:
    """Scores with both upload stages for already featurised leads."""
    scored = with_scores(rows, model.win, model.deal, model.margin)
    return scored.withColumns({"value_at_submit": model.transform.apply(F.col("value_formula")),
                               **value.close_stage(spec.horizon_days, dates.as_of)})


def as_training_schema(leads: DataFrame, extra_columns: tuple[str, ...] = ()) -> DataFrame:
    """A batch in the lead schema: absent columns null, unknown columns refused, types coerced."""
    known = set(LEADS.fieldNames()) | set(extra_columns)
    unknown = sorted(set(leads.columns) - known)
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    if "lead_id" not in leads.columns or "email" not in leads.columns:
        raise ValueError("leads need lead_id and email columns")
    types = dict(leads.dtypes)
    cells = []
    for f in LEADS:
        kind = f.dataType if f.name != "lead_id" else leads.schema["lead_id"].dataType
        c = F.col(f.name).try_cast(kind) if types.get(f.name) == "string" and f.name in types else (
            F.col(f.name).cast(kind) if f.name in types else F.lit(None).cast(kind))
        cells.append((F.coalesce(c, F.lit("{}")) if f.name == "answers" else c).alias(f.name))
    return leads.select(*cells, *[F.col(c) if c in types else F.lit(None).cast("string").alias(c) for c in extra_columns])


def featurise_batch(leads: DataFrame, companies: DataFrame, encoder: tuple[extras.FittedExtra, ...] = ()) -> DataFrame:
    """New leads featurised as in training; bots and repeats are flagged, not dropped."""
    batch = as_training_schema(leads, tuple(f.extra.column for f in encoder))
    answered = enrichment.with_answers(batch)
    flagged = cleaning.flag_bots_and_repeats(answered)
    return extras.encode(features.v2_features(enrichment.enrich(flagged, companies, keyed=answered)), encoder)


def score_batch(leads: DataFrame, companies: DataFrame, model: FittedModel) -> DataFrame:
    """Probability, values and flags of new leads with the frozen model; an unknown core level fails the job."""
    rows = featurise_batch(leads, companies, model.encoder)
    refuse = F.lit(False)
    for f, allowed in {**{k: LEVELS[k] for k in V2_REFERENCES}, **VALUE_LEVELS}.items():
        refuse = refuse | ~F.coalesce(F.col(f).isin(*allowed), F.lit(False))
    checked = rows.withColumn("lead_id", F.when(refuse, F.raise_error(F.concat(
        F.lit("lead with a value outside the model's levels: "), F.col("lead_id").cast("string"))).cast(rows.schema["lead_id"].dataType))
        .otherwise(F.col("lead_id")))
    out = with_scores(checked, model.win, model.deal, model.margin)
    return out.select("lead_id", "bot", "dup", "p_formula", "deal_value_hat", "value_formula",
                      model.transform.apply(F.col("value_formula")).alias("value_at_submit"))
