"""Categories of diagnoses, markers, regimens, imaging and laboratory values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions.text import first_class, labels_in

# Keyword lists and maps that results depend on, in their order.
ABNORMAL = ["↑", "↓", "high", "low", "elevated", "decreased"]
SITES = ["chest", "abdomen", "pelvis", "head", "brain", "neck", "spine", "lumbar", "thoracic", "cervical", "extremity", "shoulder", "knee", "hip"]
DRIVER_GENES = ["EGFR", "ALK", "KRAS", "PD-L1", "ROS1", "BRAF", "MET", "RET", "NTRK", "ERBB2", "HER2", "NRG1"]
RADIOLOGY = ["ct", "mri", "pet", "xr", "x-ray", "ultrasound", "imaging", "radiology"]
LYMPH = ["lymph", "adenopathy", "nodal"]
SMOKING = ["smoking", "tobacco", "never smok", "former smok", "current smok"]
MODALITIES = {"ct": "ct", "computed tomography": "ct", "mri": "mri", "magnetic resonance": "mri", "xray": "xray", "chest x-ray": "xray", "x-ray": "xray", "pet": "pet", "pet-ct": "pet-ct", "pet/ct": "pet-ct", "ultrasound": "ultrasound", "us": "ultrasound"}
SITE_MAP = {"chest": "chest", "thorax": "chest", "head": "head", "brain": "head", "neck": "neck", "abdomen": "abdomen", "pelvis": "pelvis", "spine": "spine", "bone": "bone", "whole body": "whole_body", "whole-body": "whole_body", "skull base to mid thigh": "whole_body"}
NOISE = ["limited evaluation", "limited exam", "without contrast", "with contrast"]
# Classes by ordered keywords: the first class of which a keyword occurs.
DIAGNOSES = [
    ("Mesothelioma", ["mesothelioma"]), ("Thymoma/Thymic", ["thymoma", "thymic"]),
    ("NSCLC", ["non-small cell", "non small cell", "nsclc", "adenocarcinoma", "squamous cell", "large cell"]), ("SCLC", ["small cell", "sclc"]),
    ("NSCLC", ["lung", "pulmonary", "bronch"]), ("Other Primary", ["pancrea", "colon", "breast", "renal", "kidney", "esophag", "gastric", "hepato", "liver"]),
]
HISTOLOGIES = [
    ("Adenocarcinoma", ["adeno"]), ("Squamous Cell", ["squamous"]), ("Large Cell", ["large cell"]), ("Small Cell", ["small cell"]),
    ("Sarcomatoid", ["sarcomatoid"]), ("Carcinoid", ["carcinoid"]), ("Mesothelioma", ["mesothelioma"]),
]
SMOKERS = [
    ("Never", ["never", "non-smoker", "nonsmoker", "non smoker", "no smoking"]), ("Current", ["current", "active smoker", "actively smoking"]),
    ("Former", ["former", "quit", "ex-smoker", "ex smoker", "stopped", "previously", "past smoker"]), ("Unknown", ["unknown", "not documented", "not recorded"]),
]
IMAGING_CLASSES = [
    ("progression", ["progression", "progressed", " pd", "worsening", "increased", "larger", "new lesion", "new met", "growing", "enlarging"]),
    ("response", ["partial response", " pr ", "complete response", " cr ", "decreased", "smaller", "reduced", "shrinking", "improving", "resolved", "resolution"]),
    ("surveillance", ["stable disease", " sd ", "stable", "no change", "unchanged", "no progression"]),
    ("baseline", ["staging", "baseline", "initial", "diagnosis", "first", "pre-treatment"]),
]
UNMUTATED = ["not detected", "negative", "wild type", "wild-type", "no mutation", "not found", "none detected", "not reported", "not documented", "pending", "insufficient", "inconclusive", "indeterminate"]
NO_GENES = ["TMB", "MSI", "MMR", "PD-L1", "Germline", "HPV/p16"]
ACTIONABLE_GENES = ["EGFR", "ALK", "KRAS", "ROS1", "BRAF", "MET", "RET", "NTRK", "ERBB2 (HER2)", "NRG1"]
DRUG_CLASSES = {
    "platinum_doublet": ["carboplatin", "cisplatin", "oxaliplatin"],
    "immunotherapy": ["pembrolizumab", "nivolumab", "atezolizumab", "durvalumab", "ipilimumab", "tremelimumab", "cemiplimab"],
    "egfr_tki": ["osimertinib", "erlotinib", "gefitinib", "afatinib", "dacomitinib", "amivantamab", "lazertinib", "mobocertinib"],
    "alk_tki": ["alectinib", "crizotinib", "ceritinib", "lorlatinib", "brigatinib"],
    "kras_inhibitor": ["sotorasib", "adagrasib"],
    "taxane": ["docetaxel", "paclitaxel", "nab-paclitaxel", "abraxane"],
    "antiangiogenic": ["bevacizumab", "ramucirumab", "nintedanib"],
    "pemetrexed": ["pemetrexed"],
    "ret_inhibitor": ["selpercatinib", "pralsetinib"],
    "ros1_inhibitor": ["entrectinib"],
    "met_inhibitor": ["capmatinib", "tepotinib"],
    "her2_targeted": ["trastuzumab", "t-dxd", "trastuzumab deruxtecan", "fam-trastuzumab"],
    "braf_targeted": ["dabrafenib", "trametinib", "encorafenib", "binimetinib"],
    "etoposide": ["etoposide"],
    "gemcitabine": ["gemcitabine"],
}
PRECEDENCE = ["surgery", "treatment", "adverse_effect", "infection", "diagnostic", "imaging", "procedure", "examination", "symptom", "lab", "critical_information"]


def lab_value(text: Column) -> Column:
    """struct(value, direction) of a laboratory string: arrows are stripped, the upper one wins, no number gives null."""
    bare = F.trim(F.translate(text, "↑↓", ""))
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    direction = F.when(text.contains("↑"), "high").when(text.contains("↓"), "low").otherwise("normal")
    return F.struct(number.alias("value"), direction.alias("direction"))


def abnormal(values: Column) -> Column:
    """The entries of a map of analytes whose value carries an abnormal marker."""
    marked = lambda v: F.exists(F.array(*map(F.lit, ABNORMAL)), lambda m: F.position(m, F.lower(v)) > 0)
    return F.map_filter(values, lambda _, v: marked(v))


def modality(name: Column) -> Column:
    """Imaging modality by ordered rules; null if none fits."""
    low = F.lower(name)
    word = lambda w: low.rlike(rf"(^|[^a-z]){w}([^a-z]|$)")
    pet, ct = word("pet") | low.contains("positron"), word("ct") | low.contains("computed tomography")
    return (
        F.when(pet & ct, "PET-CT").when(pet, "PET").when(word("mri") | word("mr") | low.contains("magnetic"), "MRI").when(ct, "CT")
        .when(word("xr") | low.contains("x-ray") | low.contains("radiograph"), "XR").when(word("us") | low.contains("ultrasound"), "US")
        .when(word("nm") | low.contains("nuclear"), "NM")
    )


def anatomic_sites(name: Column) -> Column:
    return labels_in(name, SITES)


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's value for the trimmed lower-cased key, else the key itself; unknown and empty give null."""
    key = F.lower(F.trim(value))
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when((key == "") | (key == "unknown"), None).otherwise(F.coalesce(F.try_element_at(pairs, key), key))


def cleaned_description(text: Column) -> Column:
    """The description without examination noise, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?iu)" + "|".join(NOISE), ""), r"\s+", " "))


def imaging_class(text: Column) -> Column:
    return first_class(F.coalesce(text, F.lit("")), IMAGING_CLASSES, "unknown")


def age_at(birth: Column, day: Column) -> Column:
    """Years, one digit; null outside 0 to 120."""
    years = F.datediff(day, birth) / F.lit(365.25)
    return F.when((years > 0) & (years < 120), F.bround(years, 1))


def _stated(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _any(text: Column, keywords: list[str]) -> Column:
    """Whether the lower-cased text holds a keyword; false for null."""
    return F.coalesce(F.lower(text).rlike("|".join(r"\Q" + k.lower() + r"\E" for k in keywords)), F.lit(False))


def diagnosis_class(text: Column) -> Column:
    return F.when(_stated(text), first_class(text, DIAGNOSES, "Other")).otherwise(F.lit("Unknown"))


def histology_class(text: Column) -> Column:
    return F.when(_stated(text), first_class(text, HISTOLOGIES, "Other/NOS")).otherwise(F.lit("Unknown/NOS"))


def smoking(text: Column) -> Column:
    """struct(category, pack_years): pack-years stay with Current and Former only, and alone mean Former."""
    years = F.regexp_extract(F.lower(text), r"(\d+\.?\d*)\s*(?:pack[- ]?year|ppy|py)", 1).try_cast("double")
    stated = first_class(F.coalesce(text, F.lit("")), SMOKERS, "")
    category = F.when(stated != "", stated).when(years.isNotNull(), "Former").otherwise("Unknown")
    return F.struct(category.alias("category"), F.when(category.isin("Current", "Former"), years).alias("pack_years"))


def ecog(text: Column) -> Column:
    """A grade or a range as it stands, else the first digit."""
    bare = F.trim(text)
    digit = F.regexp_extract(bare, r"(\d)", 1)
    unknown = ~_stated(text) | (~bare.contains("-") & _any(bare, ["unknown", "not"]))
    return F.when(unknown, "Unknown").when(bare.contains("-"), bare).when(digit != "", digit).otherwise("Unknown")


def mutation_status(text: Column) -> Column:
    """not_tested, negative or, for any other result, positive."""
    untested = ~_stated(F.trim(text)) | _any(text, ["not tested"])
    return F.when(untested, "not_tested").when(_any(text, UNMUTATED), "negative").otherwise("positive")


def pdl1(text: Column) -> Column:
    """negative, low, high or unknown: below one first, then the first percentage, then words."""
    share = F.regexp_extract(text, r"(\d+)\s*%", 1).try_cast("int")
    by_share = F.when(share >= 50, "high").when(share >= 1, "low").when(share == 0, "negative")
    by_word = F.when(_any(text, ["negative", "not detected"]), "negative").when(_any(text, ["positive"]), "low").otherwise("unknown")
    return F.when(~_stated(text) | _any(text, ["not tested"]), "unknown").when(_any(text, ["<1", "< 1"]), "negative").otherwise(F.coalesce(by_share, by_word))


def yes_no(text: Column) -> Column:
    first = F.upper(F.substring(F.trim(text), 1, 1))
    return F.when(first == "Y", "Yes").when(first == "N", "No").otherwise("Unknown")


def regimen(text: Column, drugs: dict[str, list[str]] | None = None) -> Column:
    """Sorted classes of which the text names a drug, and chemoradiation where it is named or radiation is concurrent."""
    held = [F.when(_any(text, names), F.lit(name)) for name, names in (DRUG_CLASSES if drugs is None else drugs).items()]
    both = _any(text, ["chemorad"]) | (_any(text, ["concurrent"]) & _any(text, ["rad"]))
    return F.array_sort(F.array_compact(F.array(*held, F.when(both, "chemoradiation"))))


def mutations(values: Column) -> Column:
    """struct(tested, positive): sorted genes of a map of results; biomarkers that are no genes are left out."""
    state = F.transform_values(F.map_filter(values, lambda k, _: ~k.isin(NO_GENES)), lambda _, v: mutation_status(v))
    tested = F.map_filter(state, lambda _, v: v != "not_tested")
    return F.struct(F.array_sort(F.map_keys(tested)).alias("tested"), F.array_sort(F.map_keys(F.map_filter(state, lambda _, v: v == "positive"))).alias("positive"))
