"""Question templates: a catalogue of built-in and custom ones, and what is saved, changed and deleted in it.

templates(id, name, category, description, is_builtin, questions): a question has an id, a text, a type, keywords, section
hints and an order. Built-in templates are a file that the user supplies, as custom ones are: one template a line of JSON.
Where an id is in both, the built-in one counts; custom ones can be changed and deleted, built-in ones can't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.search import Question

QUESTION = "struct<id:string,text:string,question_type:string,keywords:array<string>,section_hints:array<string>,order:int>"
TEMPLATE = f"id string, name string, category string, description string, is_builtin boolean, questions array<{QUESTION}>"

# The templates that a practice starts with, by id; their questions are read from a file.
BUILTIN = {
    "tpl_insurance": "Insurance Medical Report",
    "tpl_uc_fitness": "Universal Credit Fitness Assessment",
    "tpl_military": "Army Medical Report",
    "tpl_safeguarding": "Safeguarding / MASH Response",
    "tpl_pip": "DWP PIP Further Evidence (GP Factual Report)",
    "tpl_dvla": "DVLA Fitness to Drive (Medical Questionnaire)",
    "tpl_firearms": "Firearms / Shotgun Licence Medical Report",
    "tpl_adoption": "Adoption & Fostering Medical (AH2-style)",
    "tpl_occhealth": "Occupational Health / Fitness for Work Report",
    "tpl_travel": "Travel Insurance Claim (Cancellation / Curtailment)",
    "tpl_capacity": "Mental Capacity / LPA / Court of Protection (COP3-style)",
    "tpl_group2_driver": "Taxi / HGV / Group 2 Driver Medical (D4-style)",
    "tpl_housing": "Housing / Medical Priority Letter",
}


def read_templates(spark: SparkSession, path: str, builtin: bool = False) -> DataFrame:
    """Templates from JSON lines; lines that aren't JSON, or have no id, are dropped. A built-in one without a name has the fixed one."""
    rows = spark.read.schema(TEMPLATE).option("mode", "DROPMALFORMED").json(path).filter(F.col("id").isNotNull())
    named = F.coalesce("name", F.try_element_at(F.create_map(*[F.lit(x) for kv in BUILTIN.items() for x in kv]), F.col("id"))) if builtin else F.col("name")
    return rows.withColumns({"is_builtin": F.lit(builtin), "name": named})


def catalogue(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Both, with questions in their order (none: 0; ties by place) and n_questions."""
    both = builtin.unionByName(custom.join(builtin.select("id"), "id", "left_anti").select(*builtin.columns))
    placed = F.transform(F.coalesce("questions", F.array().cast(f"array<{QUESTION}>")), lambda q, i: F.struct(F.coalesce(q["order"], F.lit(0)).alias("o"), i.alias("i"), q.alias("q")))
    ordered = F.transform(F.array_sort(placed), lambda x: x["q"])
    return both.withColumns({"questions": ordered, "n_questions": F.size(ordered).cast("long")})


def save(custom: DataFrame, template: DataFrame) -> DataFrame:
    """custom with templates added at the end; one whose id is there already is kept beside it, and the first counts in ask()."""
    return custom.unionByName(template.withColumn("is_builtin", F.lit(False)))


def update(custom: DataFrame, changes: DataFrame) -> DataFrame:
    """custom with what changes(id, ...) say; a null leaves the value, an unknown id changes nothing."""
    columns = [c for c in changes.columns if c != "id"]
    out = custom.join(changes.select(F.col("id").alias("__id"), F.struct(*columns).alias("__new")), F.col("id") == F.col("__id"), "left")
    return out.withColumns({c: F.coalesce(F.col("__new")[c], F.col(c)) for c in columns}).select(*custom.columns)


def delete(custom: DataFrame, ids: DataFrame) -> DataFrame:
    return custom.join(ids.select("id"), "id", "left_anti").select(*custom.columns)


def ask(templates: DataFrame, template_id: str) -> list[Question]:
    """A template's questions in order: what one case is searched for, so few enough to hold; none for an unknown id."""
    first = templates.filter(F.col("id") == template_id).orderBy(F.col("is_builtin").desc()).limit(1)
    rows = first.select(F.explode("questions").alias("q")).select("q.*").collect()
    return [Question(r["id"], r["text"] or "", tuple(r["keywords"] or ()), tuple(r["section_hints"] or ())) for r in rows]
