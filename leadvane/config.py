"""Run parameters and the fixed values the results depend on."""
from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: dates, thresholds and model settings ----
AS_OF = "2026-09-24"
TEST_FROM = "2026-05-01"
HORIZON_DAYS = 120
STALLED_DAYS = 90
GHOSTED_DAYS = 90
BOT_MIN_TIME_ON_PAGE_S = 15
BOILERPLATE_SIMILARITY = 0.6
MIN_LEVEL_COUNT = 30
NUMERIC_BINS = 5
MISSINGNESS_FLAG = 0.5
LEAKAGE_AUC_FLAG = 0.90
MAX_ABS_DESIGN_CORR = 0.95
LR_C = 0.5
RIDGE_ALPHA = 3.0
VALUE_CAP_PERCENTILE = 97.0
VALUE_FLOOR = 25.0
POINTS_TO_DOUBLE_ODDS = 20.0
TOP_FRACTION = 0.2
CONTEXT_SCORE_CLIP = (0.001, 0.999)
CALIBRATION_CLIP = (1e-6, 1 - 1e-6)
MIN_TEST_LEADS = 100
MIN_TEST_CLASS = 10
MIN_LEADS = 200
MIN_CAPTURE_RETENTION = 0.95
MAX_OVER_MEDIAN_TARGET = 20.0
DAYS_PER_MONTH = 365.25 / 12
PLACEHOLDER_DOMAIN = "unmapped.invalid"
REASON_MAX_WORDS = 30

# ---- fixed values: word lists, spellings and patterns ----
OPEN_STAGES = ("Contacted", "Qualified", "Demo booked", "Proposal")
STAGES = ("New", *OPEN_STAGES, "Won", "Lost")
STAGE_SPELLINGS = {
    "closed won": "Won", "won": "Won", "closed lost": "Lost", "lost": "Lost", "qualified": "Qualified",
    "demo booked": "Demo booked", "proposal": "Proposal", "new": "New", "contacted": "Contacted",
}
LABEL_SOURCES = ("won", "crm_lost", "stalled", "ghosted", "open")
CLOSED_SOURCES = ("won", "crm_lost")
FREE_EMAIL_DOMAINS = ("gmail.example", "yahoo.example", "hotmail.example", "outlook.example", "icloud.example")
VAGUE_TEXTS = ("", "?", "n/a", "hi", "test", "info", "interested", "tell me more", "more info pls", "pricing")
COPY_PASTE_PREFIXES = ("lorem ipsum", "we are a leading provider", "our mission is to empower")
SPECIFIC_TEXT_PATTERN = (
    r"£\s?\d|\d+\s*(seats|users|sdrs|marketers)|team of \d|budget|within \d+ weeks|"
    r"by (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|before (q\d|end|the new)|contract ends"
)
SENIOR_TITLE_PATTERN = "ceo|founder|chief|vp|director|head|owner|partner|president|cmo|cto|cfo"
MID_TITLE_PATTERN = "manager|lead"
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
WEEKEND = WEEKDAYS[5:]
LEAD_ADS_MEDIUM = "lead_form"
CHANNEL_SOURCES = {"meta": ("facebook", "instagram"), "google": ("google",), "linkedin": ("linkedin",),
                   "chatgpt": ("chatgpt",)}
BRAND_TERM = "northstar"
MAJOR_CRMS = ("HubSpot", "Salesforce")
ANSWER_KEYS = ("country", "what_to_solve", "job_title", "company_size", "budget", "timeline", "company")
ENRICHMENT_COLUMNS = ("sector", "employee_band", "monthly_ad_spend_band", "crm_platform", "is_hiring")
LEGAL_SUFFIXES = ("ltd", "limited", "inc", "llc", "gmbh", "bv", "sa", "plc", "co", "sas", "incorporated",
                  "corporation", "corp", "company")
SESSION_INPUTS = ("time_on_page_s", "hesitation_ms", "sessions_before_convert", "viewed_pricing", "ip_country",
                  "is_datacenter_ip", "submitted_weekday", "local_submit_hour")
CLICK_ID_COLUMNS = ("gclid", "gbraid", "wbraid", "fbclid", "li_fat_id", "oppref")
PAID_CHANNELS = ("google", "meta", "linkedin", "chatgpt", "meta_leadads")
MISSING = "missing"
OTHER = "other"
ALL = "all"
BOILERPLATE_SNIPPETS = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.",
    "We are a leading provider of innovative solutions dedicated to delivering best-in-class value to our "
    "stakeholders across all verticals through synergy and excellence.",
    "Our mission is to empower businesses worldwide with cutting-edge, scalable, end-to-end solutions that "
    "drive growth, efficiency and customer delight.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "We are a customer-centric company committed to excellence, integrity and innovation in everything we do.",
    "Our vision is to be the most trusted partner for our clients by delivering world-class products and services.",
    "We leverage best-of-breed technologies to deliver holistic, future-proof solutions for the enterprise.",
    "Founded on a passion for quality, we help organisations of every size unlock their full potential.",
    "We are a dynamic, fast-growing team passionate about creating value for our customers and partners.",
    "Our award-winning team delivers bespoke, results-driven solutions tailored to your unique business needs.",
    "We pride ourselves on outstanding customer service and a commitment to continuous improvement.",
    "Synergistic, scalable and seamless: we transform the way businesses engage with their customers.",
    "This email and any attachments are confidential and intended solely for the use of the addressee.",
    "Please consider the environment before printing this email.",
    "Your satisfaction is our top priority and we look forward to building a long-lasting relationship.",
    "We deliver innovative, reliable and cost-effective solutions across a wide range of industries.",
)

# ---- fixed values: feature levels (reference level first) ----
LEVELS = {
    "channel": ("google", "meta", "meta_leadads", "linkedin", "chatgpt", "organic_direct"),
    "form_variant": ("A", "B", "C", "D"),
    "session_missing": ("no", "yes"),
    "enrichment_missing": ("no", "yes"),
    "band": ("1-10", "11-50", "51-200", "201-1000", "1000+", MISSING),
    "email": ("business", "free"),
    "text": ("neutral", "copy_paste", "vague", "specific"),
    "seniority": ("junior/ic", "student", "senior", "mid", "not_asked/blank"),
    "spend": ("under £5k", "none", "£5k-£25k", "£25k-£100k", "£100k+"),
    "crm": ("other", "hubspot_sf"),
    "hiring": ("not_hiring", "hiring"),
    "time_on_page": ("15-60s", "60-300s", "300-600s", ">600s"),
    "hesitation_90s": ("no", "yes"),
    "sessions_3plus": ("no", "yes"),
    "viewed_pricing": ("no", "yes"),
    "search_term": ("generic", "brand", "not_google"),
    "business_hours": ("outside", "wkday_9-18"),
    "ip_country": ("match", "mismatch"),
    "ip_type": ("residential", "dc"),
    "c_budget": ("not_asked", "Under £5k", "£5k-£20k", "£20k-£50k", "£50k+"),
    "c_timeline": ("not_asked", "This month", "This quarter", "Next 6 months", "Just researching"),
    "edits_1_4": ("no", "yes"),
}
# fixed values: what a form lets one choose; a company size may also be left empty
ANSWER_OPTIONS = {"company_size": LEVELS["band"][:-1], "budget": LEVELS["c_budget"][1:], "timeline": LEVELS["c_timeline"][1:]}
DROPPED_FEATURES = ("c_budget", "c_timeline", "ip_type", "edits_1_4")
FEATURES = tuple(f for f in LEVELS if f not in DROPPED_FEATURES)
LEGACY_REFERENCES = {
    "channel": "google", "form_variant": "A", "band": "1-10", "email": "business", "text": "neutral",
    "seniority": "junior/ic", "spend": "under £5k", "crm": "other", "hiring": "not_hiring",
    "time_on_page": "15-60s", "hesitation_90s": "no", "sessions_3plus": "no", "viewed_pricing": "no",
    "search_term": "generic", "business_hours": "outside", "ip_country": "match", "ip_type": "residential",
    "c_budget": "not_asked", "c_timeline": "not_asked", "edits_1_4": "no", "no_company": "no",
}
BEHAVIOURAL_FEATURES = ("time_on_page", "hesitation_90s", "sessions_3plus", "viewed_pricing", "ip_country", "ip_type",
                        "business_hours")
SECTORS = ("Education", "Financial services", "Healthcare", "Logistics", "Manufacturing", "Professional services",
           "Retail", "Software", MISSING)
VALUE_LEVELS = {"band": LEVELS["band"], "sector": SECTORS, "channel": LEVELS["channel"], "spend": LEVELS["spend"]}
ORDERED_LEVELS = {
    "band": ("1-10", "11-50", "51-200", "201-1000", "1000+"),
    "spend": ("none", "under £5k", "£5k-£25k", "£25k-£100k", "£100k+"),
    "time_on_page": ("15-60s", "60-300s", "300-600s", ">600s"),
    "seniority": ("student", "junior/ic", "mid", "senior"),
}
ABSENT_WHEN = {"spend": "enrichment_missing", "time_on_page": "session_missing"}
JUDGMENTS = {
    "is_real_business": ("yes", "no", "unclear"),
    "persona": ("buyer", "vendor", "student", "job_seeker", "competitor", "nonprofit", "agency_pitching", "unclear"),
    "problem_specificity": ("specific", "vague", "boilerplate", "unrelated"),
    "urgency": ("now", "this_quarter", "researching", "none"),
    "brief_fit": ("strong", "partial", "weak", "none"),
}
PERSONA_GROUPS = {"buyer": "buyer", "unclear": "unclear", "vendor": "non_buyer", "student": "non_buyer",
                  "job_seeker": "non_buyer", "competitor": "non_buyer", "nonprofit": "non_buyer",
                  "agency_pitching": "non_buyer"}
CONTEXT_REFERENCES = {"ctx_is_real_business": "yes", "ctx_persona_group": "buyer",
                      "ctx_problem_specificity": "specific", "ctx_urgency": "none", "ctx_brief_fit": "partial"}
CONTEXT_LEVELS = {
    "ctx_is_real_business": JUDGMENTS["is_real_business"],
    "ctx_persona_group": ("buyer", "non_buyer", "unclear"),
    "ctx_problem_specificity": JUDGMENTS["problem_specificity"],
    "ctx_urgency": JUDGMENTS["urgency"],
    "ctx_brief_fit": JUDGMENTS["brief_fit"],
}
STAMP_COLUMNS = ("brief_hash", "prompt_version", "model_id")

# ---- fixed values: rule-based benchmark (form base x multipliers x tier multiplier) ----
BENCHMARK_RULES = {
    "base_value_by_form": {"A": 150.0, "B": 300.0, "C": 600.0, "D": 200.0},
    "value_rules": [
        {"field": "country", "in": ["UK", "US"], "multiplier": 1.2},
        {"field": "channel", "in": ["linkedin"], "multiplier": 1.3},
    ],
    "lead_score": {
        "job_title": {
            "keywords": [
                {"keyword": "student", "points": 0}, {"keyword": "ceo", "points": 30},
                {"keyword": "founder", "points": 30}, {"keyword": "chief", "points": 30},
                {"keyword": "vp", "points": 30}, {"keyword": "director", "points": 30},
                {"keyword": "head", "points": 25}, {"keyword": "manager", "points": 15},
            ],
            "default_points": 10, "missing_points": 0,
        },
        "company_size_points": {"1-10": 5, "11-50": 10, "51-200": 20, "201-1000": 25, "1000+": 30},
        "pages_visited_points": [
            {"min_pages": 5, "points": 20}, {"min_pages": 3, "points": 10}, {"min_pages": 1, "points": 5},
        ],
        "tiers": [
            {"name": "A", "min_points": 55, "multiplier": 2.0}, {"name": "B", "min_points": 30, "multiplier": 1.0},
            {"name": "C", "min_points": 0, "multiplier": 0.4},
        ],
    },
}


@dataclass(frozen=True)
class RunDates:
    """The dates and thresholds of one run."""

    as_of: str = AS_OF
    test_from: str = TEST_FROM
    horizon_days: int = HORIZON_DAYS
    stalled_days: int = STALLED_DAYS
    ghosted_days: int = GHOSTED_DAYS


@dataclass(frozen=True)
class LabelSpec:
    """Which outcome definition to use: ``legacy`` or ``horizon`` with its two censoring switches."""

    mode: str = "horizon"
    horizon_days: int = HORIZON_DAYS
    include_ghosted: bool = False
    stalled_as_lost: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("legacy", "horizon"):
            raise ValueError(f"label mode {self.mode!r}; allowed: legacy, horizon")
        if self.mode == "legacy" and (self.include_ghosted or self.stalled_as_lost):
            raise ValueError("include_ghosted / stalled_as_lost only apply to horizon labels")
        if self.horizon_days < 1:
            raise ValueError(f"horizon_days must be positive, got {self.horizon_days}")

    @property
    def name(self) -> str:
        if self.mode == "legacy":
            return "legacy"
        return (f"horizon H={self.horizon_days}" + (" +ghosted" if self.include_ghosted else "")
                + (" +stalled-as-lost" if self.stalled_as_lost else ""))


def design_columns(references: dict[str, str | None], levels: dict[str, tuple[str, ...]] = LEVELS) -> list[str]:
    """``feature=level`` for every declared non-reference level, in declaration order."""
    return [f"{f}={lvl}" for f, ref in references.items() for lvl in levels[f] if lvl != ref]


V2_REFERENCES = {f: LEVELS[f][0] for f in FEATURES}
