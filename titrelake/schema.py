"""Vocabularies, lookups and schemas of measurements and evidence. The values are fixed: they must equal those of
the data that users bring."""

from __future__ import annotations

from pyspark.sql import types as T

VOCABULARY = {
    "route": ["intranasal", "inhaled", "intramuscular", "subcutaneous", "oral"],
    "platform": ["live_attenuated", "adenovirus_vector", "mrna", "inactivated", "protein_subunit", "other"],
    "compartment": ["nasal", "oral", "lower_airway", "serum", "blood_cells"],
    "method": ["nasal_wash", "nasal_swab", "nasal_mid_turbinate_swab", "nasopharyngeal_swab", "nasosorption", "nalt_biopsy", "tonsil", "saliva", "bal", "bronchosorption", "pexa", "serum", "pbmc"],
    "isotype": ["IgA", "sIgA", "IgG", "IgM", "total", "na"],
    "assay": ["elisa_binding", "multiplex_binding", "neutralization", "hai", "elispot", "flow_cytometry"],
    "normalization": ["none", "total_iga", "total_protein", "albumin", "urea"],
    "unit": ["titer", "ng_ml", "ug_ml", "au_ml", "bau_ml", "od", "ratio", "sfu_per_million", "percent"],
    "level": ["verified_abstract", "verified_fulltext", "llm_extracted", "extractive_auto", "expert_assumption", "to_verify"],
}
METHOD_COMPARTMENT = {
    "nasal_wash": "nasal", "nasal_swab": "nasal", "nasal_mid_turbinate_swab": "nasal", "nasopharyngeal_swab": "nasal",
    "nasosorption": "nasal", "nalt_biopsy": "nasal", "tonsil": "nasal", "saliva": "oral", "bal": "lower_airway",
    "bronchosorption": "lower_airway", "pexa": "lower_airway", "serum": "serum", "pbmc": "blood_cells",
}
MUCOSAL = ["nasal", "oral", "lower_airway"]
MUCOSAL_ROUTES = ["intranasal", "inhaled", "oral"]
UNIT_FACTORS = {("ng_ml", "ug_ml"): 1e-3, ("ug_ml", "ng_ml"): 1e3}
#: Levels whose statements may back a plan.
CITABLE = ["verified_abstract", "verified_fulltext", "llm_extracted", "extractive_auto"]
#: Verdicts by code.
LEVELS = ["comparable", "conditional", "not_comparable"]

CONTEXT = ["compartment", "method", "isotype", "assay", "unit", "normalization", "antigen", "lab", "source", "lloq"]
SERIES_KEY = ["compartment", "method", "isotype", "assay", "unit", "normalization", "lab", "source"]
FOLD_KEY = ["compartment", "method", "isotype", "assay", "unit", "normalization", "lab"]
REQUIRED = ["subject_id", "day", "value", "compartment", "method", "isotype", "assay", "unit"]
DEFAULTS = {"normalization": "none", "antigen": "unspecified", "lab": "lab_1", "source": "measured"}

_s, _d, _l, _i = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MEASUREMENT = _struct(
    subject_id=_s, arm_id=_s, day=_d, value=_d, compartment=_s, method=_s, isotype=_s, assay=_s, unit=_s, normalization=_s, antigen=_s,
    lab=_s, source=_s, lloq=_d, below_lloq=T.BooleanType(), responder=T.BooleanType(), total_iga=_d, row_ord=_l,
)
FLAG = _struct(code=_s, level=_i, message=_s, remedy=_s)
VACCINE = _struct(name=_s, pathogen=_s, platform=_s, route=_s)
FINDING = _struct(finding_id=_s, statement=_s, quote=_s, tags=T.ArrayType(_s), level=_s)
STUDY = _struct(
    study_id=_s, citation=_s, year=_i, doi=_s, pmid=_s, nct=_s, url=_s, pathogen=_s, vaccines=T.ArrayType(VACCINE), population=_s,
    n_participants=_i, sampling_methods=T.ArrayType(_s), compartments=T.ArrayType(_s), timepoints_days=T.ArrayType(_i), assays=T.ArrayType(_s),
    abstract=_s, full_text_excerpts=_s, findings=T.ArrayType(FINDING), not_reported=T.ArrayType(_s), level=_s,
)
EVIDENCE = _struct(studies=T.ArrayType(STUDY))
SAMPLING = _struct(day=_i, method=_s, window_days=_i)
ENDPOINT = _struct(endpoint_id=_s, label=_s, compartment=_s, method=_s, isotype=_s, assay=_s, unit=_s, normalization=_s, antigen=_s, primary=T.BooleanType())
TRIAL = _struct(name=_s, dose_days=T.ArrayType(_i), age_min=_i, age_max=_i, n_participants=_i, max_visits=_i, follow_up_days=_i, sampling=T.ArrayType(SAMPLING), endpoints=T.ArrayType(ENDPOINT))
REFERENCE = _struct(study_id=_s, finding_id=_s, citation=_s, quote=_s, url=_s)
OPTION = _struct(option_id=_s, category=_s, choice=_s, why=_s, refs=T.ArrayType(REFERENCE), assumption=T.BooleanType(), review=_s)
INTERVAL = _struct(lo=_d, hi=_d)
CURVE = _struct(baseline=_d, peak_value=_d, peak_day=_d, half_life_days=_d, fold_rise=_d, ci_peak_day=INTERVAL, ci_half_life=INTERVAL, n_subjects=_l, n_timepoints=_l, identifiable=T.BooleanType(), notes=T.ArrayType(_s))
CONTEXT_MODEL = _struct(**{c: _d if c == "lloq" else _s for c in CONTEXT})
MODELS = {"measurement": MEASUREMENT, "flag": FLAG, "vaccine": VACCINE, "finding": FINDING, "study": STUDY, "evidence": EVIDENCE, "sampling": SAMPLING, "endpoint": ENDPOINT, "trial": TRIAL}
MODELS |= {"reference": REFERENCE, "option": OPTION, "curve": CURVE, "context": CONTEXT_MODEL}
