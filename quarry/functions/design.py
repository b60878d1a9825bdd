"""Study designs: scores, labels, and the reading of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score and label of each design.
DESIGNS = {
    "meta_analysis": (1.00, "meta-analysis"), "systematic_review": (0.95, "systematic review"), "guideline": (0.92, "clinical guideline"), "rct": (0.82, "randomised controlled trial"),
    "drug_label": (0.78, "regulatory drug label"), "controlled_trial": (0.72, "controlled trial"), "cohort": (0.62, "cohort study"), "trial_registry": (0.55, "registered trial"),
    "case_control": (0.52, "case-control study"), "narrative_review": (0.48, "review"), "cross_sectional": (0.42, "cross-sectional study"), "unknown": (0.40, ""),
    "surveillance": (0.38, "adverse-event surveillance"), "preclinical": (0.30, "preclinical study"), "case_report": (0.25, "case report"), "commentary": (0.20, "editorial or commentary"), "encyclopedic": (0.15, "encyclopedic"),
}
#: Designs that a provider fixes, and those of publication types.
PROVIDER_DESIGNS = {
    "dailymed": "drug_label", "openfda": "drug_label", "rxnav": "drug_label", "ema": "drug_label", "clinicaltrials": "trial_registry", "wikipedia": "encyclopedic", "who_gho": "surveillance", "chembl": "preclinical", "open_targets": "preclinical",
}
TYPE_DESIGNS = {
    "meta-analysis": "meta_analysis", "systematic review": "systematic_review", "practice guideline": "guideline", "guideline": "guideline", "consensus development conference": "guideline",
    "randomized controlled trial": "rct", "controlled clinical trial": "controlled_trial", "clinical trial": "controlled_trial", "clinical trial, phase iii": "rct", "clinical trial, phase ii": "controlled_trial",
    "pragmatic clinical trial": "controlled_trial", "equivalence trial": "controlled_trial", "adaptive clinical trial": "controlled_trial", "observational study": "cohort", "multicenter study": "cohort",
    "comparative study": "cohort", "twin study": "cohort", "case reports": "case_report", "review": "narrative_review", "editorial": "commentary", "letter": "commentary", "comment": "commentary", "news": "commentary", "published erratum": "commentary",
}
#: The wording of designs, the most specific first, and of preprints.
PATTERNS = (
    ("meta_analysis", r"\bmeta[- ]?analy(?:sis|ses|tic)\b|\bnetwork meta\b|\bpooled analysis\b"),
    ("systematic_review", r"\bsystematic review\b|\bcochrane review\b|\bscoping review\b|\bumbrella review\b|\bevidence synthesis\b|\brapid review\b"),
    ("guideline", r"\b(?:clinical |practice |treatment )?guidelines?\b|\bconsensus statement\b|\bposition (?:paper|statement)\b|\brecommendations? (?:of|from|for) the\b|\bexpert consensus\b"),
    ("rct", r"\brandomi[sz]ed\b|\brandomi[sz]ation\b|\bdouble[- ]blind\b|\bplacebo[- ]controlled\b|\bphase (?:ii|iii|2|3) trial\b|\brct\b"),
    ("controlled_trial", r"\bclinical trial\b|\bcontrolled trial\b|\bopen[- ]label trial\b|\bcrossover (?:trial|study)\b|\bnon[- ]inferiority\b"),
    ("cohort", r"\bcohort\b|\bprospective (?:study|analysis|follow)\b|\blongitudinal (?:study|analysis)\b|\bregistry[- ]based\b"),
    ("case_control", r"\bcase[- ]control\b|\bnested case\b"),
    ("cross_sectional", r"\bcross[- ]sectional\b|\bsurvey (?:of|among|study)\b|\bprevalence (?:of|study)\b|\bnhanes\b"),
    ("case_report", r"\bcase report\b|\bcase series\b|\ba case of\b|\bwe report a\b"),
    ("preclinical", r"\bin vitro\b|\bin vivo\b|\bmouse\b|\bmurine\b|\brats?\b|\bzebrafish\b|\bcell line\b|\bmolecular docking\b|\bknockout\b|\bxenograft\b"),
    ("narrative_review", r"\breview\b|\boverview of\b|\bstate of the art\b|\bcurrent perspectives\b|\bnarrative synthesis\b"),
)
PREPRINT = r"\bpreprint\b|\bbiorxiv\b|\bmedrxiv\b|\bnot .{0,20}peer[- ]reviewed\b"
PREPRINT_FACTOR, SCAN_CHARS = 0.75, 700


def _map(values: dict, kind: str = "string") -> Column:
    return F.create_map(*(F.lit(x) for item in values.items() for x in item)).cast(f"map<string,{kind}>")


def scan_text(title: Column, content: Column, snippet: Column) -> Column:
    body = F.coalesce(F.nullif(content, F.lit("")), snippet, F.lit(""))
    return F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), body), 1, SCAN_CHARS)


def score(design: Column, preprint: Column | None = None) -> Column:
    value = F.coalesce(_map({k: v for k, (v, _) in DESIGNS.items()}, "double")[design], F.lit(DESIGNS["unknown"][0]))
    return value if preprint is None else F.when(preprint, value * PREPRINT_FACTOR).otherwise(value)


def label(design: Column, preprint: Column) -> Column:
    name = F.coalesce(_map({k: v for k, (_, v) in DESIGNS.items()})[design], F.lit(""))
    return F.when(preprint & (name != ""), F.concat(name, F.lit(" (preprint)"))).when(preprint, "preprint").otherwise(name)


def normalise(design: Column) -> Column:
    """A design id from a name in prose, or null."""
    plain = F.trim(F.regexp_replace(F.lower(F.trim(design)), r"\(preprint\)$", ""))
    plain = F.translate(plain, "- ", "__")
    names = {d: d for d in DESIGNS}
    for d, (_, text) in DESIGNS.items():
        if text:
            key = text.lower().replace("-", "_").replace(" ", "_")
            names.setdefault(key, d)
            names.setdefault(key.replace("randomised", "randomized"), d)
    return _map(names)[plain]


def type_design(types: Column) -> Column:
    """The design of highest score among publication types, or null."""
    known = F.transform(types, lambda t: F.coalesce(_map(TYPE_DESIGNS)[F.lower(F.trim(t))], normalise(t)))
    ranked = F.transform(F.filter(known, lambda d: d.isNotNull() & (d != "unknown")), lambda d: F.struct(score(d).alias("s"), d.alias("d")))
    return F.array_max(ranked)["d"]


def is_preprint(source: Column, text: Column) -> Column:
    return (F.lower(F.trim(source)) == "biorxiv") | text.rlike("(?i)" + PREPRINT)


def detect(source: Column, types: Column, text: Column) -> Column:
    """Provider fact, else publication type, else the first pattern in the text, else unknown."""
    worded = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        worded = F.when(text.rlike("(?i)" + pattern), name).otherwise(worded)
    return F.coalesce(_map(PROVIDER_DESIGNS)[F.lower(F.trim(source))], type_design(types), worded, F.lit("unknown"))


def of_article(read: Column, source: Column, types: Column, text: Column) -> Column:
    """An external reading of the full text wins unless it is unknown."""
    named = normalise(read)
    return F.coalesce(F.when(named != "unknown", named), detect(source, types, text))


#: What results, status, phase and enrolment add to a trial's score, by how its text states them; of each list the first that is found counts.
TRIAL_RESULTS, TRIAL_STATUS, TRIAL_PHASE, TRIAL_SIZE = 100, (("completed", 50), ("active", 30), ("recruiting", 20)), (("phase ?3", 15), ("phase ?4", 12), ("phase ?2", 8)), ((1000, 20), (100, 10))


def trial_score(text: Column) -> Column:
    """A trial's score by what its text says."""
    low = F.lower(F.coalesce(text, F.lit("")))
    enrolled = F.coalesce(F.regexp_extract(low, r"enroll?ment: (\d+)", 1).try_cast("long"), F.lit(0))

    def first(rules, found) -> Column:
        out = F.lit(0)
        for rule, points in reversed(rules):
            out = F.when(found(rule), points).otherwise(out)
        return out

    return F.when(F.contains(low, F.lit("has posted results")), TRIAL_RESULTS).otherwise(0) + first(TRIAL_STATUS, lambda w: F.contains(low, F.lit(w))) + first(TRIAL_PHASE, low.rlike) + first(TRIAL_SIZE, lambda n: enrolled > n)
