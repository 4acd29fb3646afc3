"""Deterministic retrieval over source events: mentions, latest documents, histories, imaging dates, one context row for each patient."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import clinical, text
from chronoweave.operators import rollup, temporal

# The topics' keywords, the code status terms that must match case and stand alone, and words that are no operation.
TOPICS = {
    "metastasis": ["metasta"],
    "lymph": clinical.LYMPH,
    "smoking": clinical.SMOKING,
    "ecog": ["ecog", "performance status"],
    "allergy": ["allerg"],
    "radiation": ["radiation", "radiotherapy", "SBRT", "IMRT", "proton therapy", "chemoradiation", "XRT", "brachytherapy", "stereotactic"],
    "surgery": ["resection", "VATS", "thoracotomy", "Whipple", "operative report", "surgical", "lumpectomy"],
    "toxicity": ["toxicity", "adverse event", "grade 3", "grade 4", "grade 5", "neutropenia", "thrombocytopenia", "pneumonitis", "hepatotoxicity", "neuropathy"],
    "comorbidity": ["COPD", "CHF", "heart failure", "diabetes", "renal insufficiency", "renal failure", "chronic kidney", "cirrhosis", "hepatic failure", "pulmonary embolism", "deep vein thrombosis"],
    "molecular": ["UCSF500", "FoundationOne", "Guardant", "Tempus", "NGS panel", "next-generation sequencing", "genomic profiling", "molecular testing", "molecular profiling", "pathogenic variant", "no pathogenic", "tumor mutational burden", "microsatellite", "MSI"],
}
#: Characters on each side of a mention.
AROUND = {"smoking": 400}
CODE_STATUS = ["DNR", "DNI", "POLST"]
LOOSE_STATUS = ["code status", "full code", "goals of care", "do not resuscitate", "do-not-resuscitate", "advance directive", "allow natural death", "comfort measures only", "CMO"]
SURGICAL = r"(?iu)\b(\w{3,}(?:ectomy|otomy))\b"
NOT_SURGICAL = ("anatomy", "phlebotomy", "tracheostomy")
TNM = {"T": r"(?i)\bT[0-4is x]\b", "N": r"(?i)\bN[0-3x]\b", "M": r"(?i)\bM[01x]\b"}


def searchable(events: DataFrame) -> DataFrame:
    """events with `_text`: value, name and description in one."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("value", "name", "description") if c in events.columns]
    return events.withColumn("_text", F.concat_ws(" ", *parts))


def mentions(events: DataFrame, keywords: list[str], around: int = 250, word: bool = False, case_sensitive: bool = False) -> DataFrame:
    """One row for each event and keyword; with `word` the keyword must stand alone, and its place and snippet are those of such an occurrence."""
    return text.keyword_hits(searchable(events), "_text", keywords, around, case_sensitive, word).drop("_text")


def latest_and_count(hits: DataFrame, by: list[str]) -> DataFrame:
    """Per group: how many events, the latest one (first in order among equals) and its snippet."""
    one = hits.groupBy(*by, "node_id").agg(F.min_by(F.struct("date", "seq", "snippet"), "kw_seq").alias("x"))
    later = W.partitionBy(*by).orderBy(F.col("x.date").desc(), F.col("x.seq"))
    ranked = one.withColumns({"_n": F.row_number().over(later), "n": F.count("*").over(W.partitionBy(*by))})
    return ranked.where("_n = 1").select(*by, "n", "node_id", F.col("x.date").alias("date"), F.col("x.snippet").alias("snippet"))


def topic(events: DataFrame, name: str, around: int | None = None) -> DataFrame:
    """Latest mention and count of a topic for each patient."""
    return latest_and_count(mentions(events, TOPICS[name], around or AROUND.get(name, 250)), ["patient_id"])


def topics(events: DataFrame) -> DataFrame:
    """The same for all topics at once, by patient and topic: one pass over the events."""
    whose = [(name, k) for name, ks in TOPICS.items() for k in ks]
    hits = mentions(events, [k for _, k in whose], max(AROUND.values()))
    return latest_and_count(hits.withColumn("topic", F.get(F.array(*[F.lit(n) for n, _ in whose]), F.col("kw_seq"))), ["patient_id", "topic"])


def recent_mentions(events: DataFrame, name: str, most: int) -> DataFrame:
    """Per patient the latest events that mention a topic, each by its first keyword."""
    hits = mentions(events, TOPICS[name], AROUND.get(name, 250))
    first = temporal.top_per_group(hits, ["patient_id", "node_id"], ["kw_seq"], 1, "_n").drop("_n")
    return temporal.top_per_group(first, ["patient_id"], [F.col("date").desc(), "seq"], most)


def latest_by_kind(events: DataFrame, name: str) -> DataFrame:
    """patient_id, kind (note, radiology) and the latest event of that kind that mentions a topic; radiology by the event's name."""
    kinds = F.array_compact(F.array(F.when(F.col("type") == "note", "note"), F.when(clinical._any(F.col("name"), clinical.RADIOLOGY), "radiology")))
    hits = mentions(events, TOPICS[name], AROUND.get(name, 250)).withColumn("kind", F.explode(kinds))
    return temporal.top_per_group(hits, ["patient_id", "kind"], [F.col("date").desc(), "seq", "kw_seq"], 1).select("patient_id", "kind", "node_id", "date", "snippet")


def allergies(events: DataFrame) -> DataFrame:
    """All mentions of allergies; of a note the sentence that has it, cut from its snippet."""
    hits = mentions(events, TOPICS["allergy"])
    told = F.when(F.col("type") == "note", text.sentence_with(F.col("snippet"), TOPICS["allergy"][0])).otherwise(F.col("snippet"))
    return hits.select("patient_id", "node_id", "date", "type", told.alias("told"))


def driver_genes(events: DataFrame) -> DataFrame:
    """Latest mention and count for each patient and gene; genes match case and stand alone; 'driver mut' in any case counts as one more."""
    genes = mentions(events, clinical.DRIVER_GENES, word=True, case_sensitive=True)
    told = mentions(events, ["driver mut"]).withColumn("keyword", F.lit("_driver_mutation_keyword"))
    return latest_and_count(genes.unionByName(told).withColumnRenamed("keyword", "gene"), ["patient_id", "gene"])


def tnm(events: DataFrame) -> DataFrame:
    """patient_id, component (T, N, M), how many events name it and the latest one with what it names."""
    found = F.array_compact(F.array(*[F.when(F.regexp_extract("_text", f"({p})", 1) != "", F.struct(F.lit(k).alias("component"), F.regexp_extract("_text", f"({p})", 1).alias("stated"))) for k, p in TNM.items()]))
    each = searchable(events).select("patient_id", "node_id", "date", "seq", F.explode(found).alias("x")).select("*", "x.component", "x.stated")
    order = W.partitionBy("patient_id", "component").orderBy(F.col("date").desc(), "seq")
    ranked = each.withColumns({"_n": F.row_number().over(order), "n": F.count("*").over(W.partitionBy("patient_id", "component"))})
    return ranked.where("_n = 1").select("patient_id", "component", "n", "node_id", "date", "stated")


def code_status(events: DataFrame, most: int = 8) -> DataFrame:
    """Per patient the latest mentions, for each event the longest snippet."""
    strict = mentions(events, CODE_STATUS, 300, word=True, case_sensitive=True)
    both = strict.unionByName(mentions(events, LOOSE_STATUS, 300).withColumn("kw_seq", F.col("kw_seq") + len(CODE_STATUS)))
    longest = temporal.top_per_group(both, ["patient_id", "node_id"], [F.length("snippet").desc(), "kw_seq"], 1, "_n").drop("_n")
    return temporal.top_per_group(longest, ["patient_id"], [F.col("date").desc(), "seq"], most)


def distinct_conditions(events: DataFrame) -> DataFrame:
    """Per patient and code (or name) the earliest condition."""
    key = F.when(F.col("code") != "", F.col("code")).otherwise(F.col("name"))
    rows = events.where("type = 'condition'").withColumn("key", key).where("key <> ''")
    return rows.groupBy("patient_id", "key").agg(F.min_by("name", F.struct("date", "seq")).alias("name"), F.min("date").alias("first_date"), F.count("*").alias("n"))


def drug_exposures(events: DataFrame) -> DataFrame:
    """Per patient and drug: first and last date, count and the ids in order."""
    key = F.when(F.col("code") != "", F.col("code")).otherwise(F.col("name"))
    rows = events.where("type = 'drug_exposure'").withColumn("key", key).where("key <> ''")
    return rows.groupBy("patient_id", "key").agg(F.min_by("name", "seq").alias("name"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"), rollup.ordered_list(F.col("node_id"), F.col("seq")).alias("ids"))


def visits_named(events: DataFrame, names: list[str], sites: DataFrame | None = None) -> DataFrame:
    """patient_id and visit_id of visits whose name, or whose care site's name, holds one of `names`."""
    has = lambda c: reduce(lambda a, b: a | b, [F.upper(c).contains(n.upper()) for n in names])
    own = events.where("type in ('visit', 'visit_detail') and visit_id <> ''").where(has("name")).select("patient_id", "visit_id")
    if sites is not None:
        at = events.where("visit_id <> '' and care_site_id <> ''").join(sites.where(has("care_site_name")).select("patient_id", "care_site_id").distinct(), ["patient_id", "care_site_id"], "left_semi")
        own = own.unionByName(at.select("patient_id", "visit_id"))
    return own.distinct()


def latest_note_of_visits(events: DataFrame, sites: DataFrame | None, names: list[str]) -> DataFrame:
    """Per patient the latest note of the visits of `visits_named`, with its whole text and how many such notes there are."""
    notes = events.where("type = 'note'").join(visits_named(events, names, sites), ["patient_id", "visit_id"], "left_semi")
    whole = notes.withColumns({"value": F.concat_ws(" ", "value", "name"), "n": F.count("*").over(W.partitionBy("patient_id"))})
    return temporal.top_per_group(whole, ["patient_id"], [F.col("date").desc(), "seq"], 1).select("patient_id", "node_id", "date", "value", "n")


def chest_ct_report(events: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Per patient the latest note that reads as a chest CT report: CT, chest and a report's headings, no pathology, not of an oncology visit.

    Of equal times an attending's note comes first.
    """
    t = F.concat_ws(" ", "value", "name")
    found = events.where("type = 'note'").where(clinical._any(t, ["ct", "computed tomography"]) & clinical._any(t, ["chest", "thorax"]) & clinical._any(t, ["impression:", "findings:", "technique:"]))
    found = found.where(~clinical._any(t, ["pathologist:", "surgical pathology report", "specimen:"])).join(visits_named(events, ["oncology"], sites), ["patient_id", "visit_id"], "left_anti")
    order = [F.col("timestamp").desc(), F.col("name").contains("Attending").desc(), "seq"]
    return temporal.top_per_group(found, ["patient_id"], order, 1).select("patient_id", "node_id", "date", "value")


def reads_as_radiology(note: Column) -> Column:
    """Whether a note reads as an imaging report: a modality word near its start, outside boilerplate, and the shape of a report."""
    low = F.lower(note)
    at = F.regexp_instr(low, F.lit(r"\b(ct|mri|pet|x-ray|ultrasound)\b"))
    near = F.substring(low, F.greatest(at - 60, F.lit(1)), F.lit(160))
    shape = F.substring(low, 1, 3000).rlike("impression|findings|technique|comparison")
    return (at > 0) & (at < 1500) & ~near.rlike("will order|scheduled for|plan to obtain") & shape


def imaging_dates(events: DataFrame, gap: int = 7) -> DataFrame:
    """Per patient and modality the first date of each run of studies no more than `gap` days after the one before."""
    structured = events.where("type in ('image', 'procedure')").select("patient_id", F.col("date").alias("d"), clinical.modality(F.col("name")).alias("modality"))
    notes = events.where("type = 'note'").where(reads_as_radiology(F.col("value")))
    stated = notes.select("patient_id", F.coalesce(text.us_date(F.substring("value", 1, 2000)), F.col("date")).alias("d"), F.coalesce(clinical.modality(F.substring("value", 1, 500)), clinical.modality(F.substring("value", 1, 2000))).alias("modality"))
    studies = structured.unionByName(stated).where("modality is not null").dropDuplicates().withColumn("day", F.try_to_date("d", "yyyy-MM-dd"))
    clustered = temporal.gap_clusters(studies, ["patient_id", "modality"], [F.col("day").asc_nulls_first(), "d"], F.datediff("day", "_before.day"), gap)
    return clustered.groupBy("patient_id", "modality", "cluster").agg(F.min("d").alias("date")).drop("cluster")


def recent_imaging(events: DataFrame, as_of: str, days: int = 180, most: int = 3) -> DataFrame:
    """Per patient and modality the latest studies of the days before `as_of`."""
    day = F.try_to_date("date", "yyyy-MM-dd")
    rows = events.where("type in ('image', 'procedure')").withColumns({"modality": clinical.modality(F.col("name")), "site": clinical.anatomic_sites(F.col("name"))})
    rows = rows.where(F.col("modality").isNotNull() & (day > F.date_sub(F.lit(as_of).cast("date"), days)) & (day <= F.lit(as_of).cast("date")))
    return temporal.top_per_group(rows, ["patient_id", "modality"], [F.col("date").desc(), "seq"], most).select("patient_id", "modality", "site", "date", "node_id", "rank")


def surgical_history(events: DataFrame, stop: tuple[str, ...] = NOT_SURGICAL) -> DataFrame:
    """Per patient the distinct operations that notes name, with the first date."""
    found = searchable(events).withColumn("operation", F.lower(F.regexp_extract("_text", SURGICAL, 1))).where((F.col("operation") != "") & ~F.col("operation").isin(list(stop)))
    return found.groupBy("patient_id", "operation").agg(F.min("date").alias("first_date"), F.count("*").alias("n"))


def context(events: DataFrame) -> DataFrame:
    """One row for each patient with what the topics, conditions and drugs give, as structs."""
    out = events.select("patient_id").distinct()
    for name in TOPICS:
        found = topic(events, name)
        out = out.join(found.select("patient_id", F.struct("n", "date", "snippet").alias(name)), "patient_id", "left")
    conditions = distinct_conditions(events).groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("first_date", "name"))).alias("conditions"))
    drugs = drug_exposures(events).groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("first_date", "last_date", "name", "n"))).alias("drugs"))
    return out.join(conditions, "patient_id", "left").join(drugs, "patient_id", "left")


def guidance(contexts: DataFrame, most: int = 5) -> DataFrame:
    """patient_id and a text block of the context for a prompt."""
    line = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(f"{n}.n").cast("string"), F.lit(" mentions, latest "), F.col(f"{n}.date"), F.lit(": "), F.col(f"{n}.snippet")))
    listed = F.when(F.size("conditions") > 0, F.concat(F.lit("conditions: "), F.array_join(F.transform(F.slice("conditions", 1, most), lambda x: F.concat_ws(" ", x["first_date"], x["name"])), "; ")))
    return contexts.select("patient_id", F.concat_ws("\n", *[line(n) for n in TOPICS], listed).alias("guidance"))


def serialized(events: DataFrame, people: DataFrame | None = None, max_chars: int | None = None) -> DataFrame:
    """patient_id, date, block, size: the day's events as lines numbered by date and id, laboratory values last by time, whole texts.

    Imaging procedures are named as such; `people` (patient_id, birthdate, gender, age_years, race, ethnicity) gives each patient a first
    block of demographics, dated ''. A limit of `max_chars` for each value is the caller's choice.
    """
    order = W.partitionBy("patient_id").orderBy(F.when(F.col("date") == "", "9999-99-99").otherwise(F.col("date")), "node_id")
    numbered = events.withColumn("ref", F.concat(F.lit("[E"), F.row_number().over(order).cast("string"), F.lit("]")))
    lab = F.col("type").isin("measurement", "lab", "vital")
    value = F.col("value") if max_chars is None else text.truncated(F.col("value"), max_chars)
    unit = F.col("unit") if "unit" in events.columns else F.lit("")
    shown = F.when((F.col("type") == "procedure") & clinical.modality(F.col("name")).isNotNull(), F.concat(F.lit("imaging_procedure ["), clinical.modality(F.col("name")), F.lit("]"))).otherwise(F.col("type"))
    named = lambda head: F.concat(F.concat_ws(" ", F.col("ref"), head, F.when(F.col("name") != "", F.col("name"))), F.when(F.col("value") != "", F.concat(F.lit(": "), value)).otherwise(F.lit("")))
    line = F.when(lab, F.trim(F.concat_ws(" ", named(F.lit(None).cast("string")), F.when(unit != "", unit)))).otherwise(named(shown))
    rows = numbered.withColumns({"_lab": lab.cast("int"), "_at": F.when(lab, F.col("timestamp")).otherwise(F.lit("")), "_line": line, "_first": F.row_number().over(W.partitionBy("patient_id", "date", lab, F.when(lab, F.col("timestamp"))).orderBy("node_id"))})
    headed = F.when((F.col("_lab") == 1) & (F.col("_first") == 1), F.concat(F.lit("--- Labs "), F.col("timestamp"), F.lit(" ---\n"), F.col("_line"))).otherwise(F.col("_line"))
    days = rows.withColumn("_line", headed).groupBy("patient_id", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("_lab", "_at", "node_id", "_line"))), lambda x: x["_line"]).alias("lines"))
    out = days.select("patient_id", "date", F.concat_ws("\n", F.concat(F.lit("=== "), F.col("date"), F.lit(" ===")), F.array_join("lines", "\n")).alias("block"))
    if people is not None:
        labels = {"birthdate": "Date of Birth", "gender": "Sex", "age_years": "Age", "race": "Race", "ethnicity": "Ethnicity"}
        told = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {label}: "), F.col(c).cast("string"))) for c, label in labels.items()]
        out = out.unionByName(people.select("patient_id", F.lit("").alias("date"), F.concat_ws("\n", F.lit("=== DEMOGRAPHICS ==="), *told).alias("block")))
    return out.withColumn("size", F.length("block"))


def listing(events: DataFrame, longest: int = 150, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """patient_id and a numbered listing with snippets; and the reference map (patient_id, ref, node_id). Numbers go by date, then place."""
    order = W.partitionBy("patient_id").orderBy(F.when(F.col("date") == "", "9999-99-99").otherwise(F.col("date")), "seq")
    numbered = events.withColumn("_i", F.row_number().over(order))
    numbered = numbered if most is None else numbered.where(F.col("_i") <= most)
    ref = F.concat(F.lit("E"), F.col("_i").cast("string"))
    kind = F.get(F.split("node_id", "_"), 0)
    line = F.concat(F.lit("  ["), ref, F.lit("] "), kind, F.when(F.trim("value") != "", F.concat(F.lit(": "), text.truncated(F.trim("value"), longest))).otherwise(F.lit("")))
    days = numbered.withColumn("_line", line).groupBy("patient_id", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda x: x["_line"]), "\n").alias("lines"), F.count("*").alias("n"))
    block = F.concat_ws("\n", F.when(F.col("date") == "", "UNKNOWN").otherwise(F.col("date")), "lines")
    whole = days.groupBy("patient_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("blocks"))
    told = whole.select("patient_id", F.concat(F.lit("Total source events available: "), F.col("n").cast("string"), F.lit("\n\n"), F.col("blocks")).alias("listing"))
    return told, numbered.select("patient_id", ref.alias("ref"), "node_id")


def chunked(blocks: DataFrame, limit: int = 30_000) -> DataFrame:
    """patient_id, chunk_no, text: day blocks packed greedily in order."""
    packed = temporal.greedy_chunks(blocks, ["patient_id"], ["date"], "size", limit)
    return packed.groupBy("patient_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "block"))), lambda x: x["block"]), "\n\n").alias("text"))
