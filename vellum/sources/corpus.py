"""A corpus of notes with planted personal data and its answer key, made by a data source from a seed.

Every note draws from a random stream of its own, counted from the seed and its number, so the corpus is the same however it
is dealt into partitions, and one partition can be made again alone. Options: seed, n (notes), partitions, pages (of the
demo record: notes that are pages of one file). Names come from the lists that detection knows and, for a share of the notes,
one part from outside them, so that recall can fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellum.functions import lexicons as L

NOTE = "doc_id long, source_file string, page_num int, text string, planted array<struct<category:string,text:string>>"
FORENAMES, SURNAMES = sorted(L.DEFAULT_LEXICON.forenames), sorted(L.DEFAULT_LEXICON.surnames)
#: Names outside the lists, and the share of notes that plant one of them.
OUTSIDE, OUTSIDE_SHARE = ("zbigniew", "okafor", "anneke", "lindqvist", "tadashi", "moreau"), 0.25
#: Layouts of a planted name, and which parts a finding must hold.
LAYOUTS = (
    ("contact: {f} {s}", "fs"), ("daughter {f} {s}", "fs"), ("seen by Dr {s}", "s"), ("Mrs {s}", "s"), ("{S}, {f}", "fs"), ("{F} {S}", "fs"), ("{f} {s} (Carer)", "fs"),
    ("Dear Mr {s},", "s"), ("{s}, {f}", "fs"), ("wife {f}", "f"),
)
NOISE = ("BLOOD PRESSURE 120/80", "Dose: 5 mg daily", "Barrett Oesophagus", "NO KNOWN ALLERGIES", "Review in six weeks", "Parkinson Disease", "weight 71.5 kg")


def _title(name: str) -> str:
    return "".join(c.upper() if i == 0 or name[i - 1] == "'" else c for i, c in enumerate(name))


def checked_number(draw: np.random.Generator) -> str:
    """Ten digits whose last one is their check digit."""
    while True:
        d = draw.integers(0, 10, 9)
        check = 11 - int((d * np.arange(10, 1, -1)).sum()) % 11
        if check != 10:
            s = "".join(map(str, d)) + str(check % 11)
            return f"{s[:3]} {s[3:6]} {s[6:]}"


def note(seed: int, i: int) -> tuple[str, list[tuple[str, str]]]:
    """The text and answers of note i."""
    draw = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, i]))
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    lines, planted = [f"Note {i}"], []
    for _ in range(int(draw.integers(1, 4))):
        f, s = pick(FORENAMES), pick(SURNAMES)
        if draw.random() < OUTSIDE_SHARE:
            f, s = (pick(OUTSIDE), s) if draw.random() < 0.5 else (f, pick(OUTSIDE))
        layout, parts = pick(LAYOUTS)
        f, s = _title(f), _title(s)
        lines += [layout.format(f=f, s=s, F=f.upper(), S=s.upper()), pick(NOISE)]
        planted.append(("person_name", " ".join({"f": f, "s": s}[p] for p in parts)))
    letters, digits = "ABCDEFGHJKLMNPRSTUWYZ", "0123456789"
    extra = {
        "nhs_number": lambda: checked_number(draw), "phone_number": lambda: "07" + "".join(pick(digits) for _ in range(3)) + " " + "".join(pick(digits) for _ in range(6)),
        "postcode": lambda: pick(letters) + pick(letters) + pick("123456789") + " " + pick("123456789") + pick(letters) + pick(letters), "email": lambda: f"{pick(SURNAMES).replace(chr(39), '')}{i}@example.org",
    }
    for category, make in extra.items():
        if draw.random() < 0.5:
            value = make()
            lines.append(f"{category.replace('_', ' ')}: {value}")
            planted.append((category, value))
    return "\n".join(lines), planted


@dataclass
class Numbers(InputPartition):
    lo: int
    hi: int


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.seed, self.n, self.parts, self.pages = (int(options.get(k, v)) for k, v in (("seed", 42), ("n", 200), ("partitions", 8), ("pages", 1)))

    def partitions(self) -> list[Numbers]:
        cuts = [self.n * p // self.parts for p in range(self.parts + 1)]
        return [Numbers(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a] or [Numbers(0, 0)]

    def read(self, part: Numbers) -> Iterator[tuple]:
        for i in range(part.lo, part.hi):
            text, planted = note(self.seed, i)
            yield i // self.pages, f"note{i // self.pages}.txt", i % self.pages, text, planted


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "planted_notes"

    def schema(self) -> str:
        return NOTE

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)


def planted_notes(spark: SparkSession, n: int = 200, seed: int = 42, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(CorpusSource)
    return spark.read.format("planted_notes").options(n=n, seed=seed, partitions=partitions).load()


def demo_record(spark: SparkSession, pages: int = 4, seed: int = 20240101) -> DataFrame:
    """One file of some pages, the same in every session."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("planted_notes").options(n=pages, seed=seed, partitions=1, pages=pages).load()


def add_demo(cases: DataFrame, spark: SparkSession, case_id: str = "demo") -> DataFrame:
    """cases(id, full_name, archived, ...) with a demo case, unless one that isn't archived is there: named SYNTHETIC."""
    here = cases.filter(F.contains(F.upper(F.coalesce("full_name", F.lit(""))), F.lit("SYNTHETIC")) & ~F.coalesce("archived", F.lit(False)))
    made = spark.createDataFrame([(case_id, "DEMO PATIENT — SYNTHETIC DATA", False)], "id string, full_name string, archived boolean")
    wanted = made.join(here.select(F.lit(1).alias("__one")).limit(1), F.lit(True), "left_anti")
    return cases.unionByName(wanted, allowMissingColumns=True)


def quality(notes: DataFrame, found: DataFrame) -> DataFrame:
    """(category, planted, hit, recall, found, right, prec): findings(doc_id, category, text) against the notes' answer key.

    A planted name is hit by a finding of its note that holds all its words; a value by one that equals it. A finding is right
    where it shares a word with what was planted in its category."""
    words = lambda c: F.split(F.lower(F.regexp_replace(c, r"[^\w@.' -]", " ")), r"[\s]+")
    keys = notes.select("doc_id", F.posexplode("planted").alias("i", "p")).select("doc_id", "i", "p.category", F.col("p.text").alias("want"))
    got = found.select(F.col("doc_id").alias("__d"), F.col("category").alias("__c"), F.col("text").alias("got"), F.monotonically_increasing_id().alias("f"))
    same = (F.col("doc_id") == F.col("__d")) & (F.col("category") == F.col("__c"))
    pairs = keys.join(got, same, "left")
    holds = F.size(F.array_except(words("want"), words("got"))) == 0
    hit = pairs.groupBy("doc_id", "i", "category").agg(F.coalesce(F.max(holds.cast("int")), F.lit(0)).alias("hit")).groupBy("category").agg(F.count("*").alias("planted"), F.sum("hit").alias("hit"))
    back = got.join(keys, same, "left").groupBy("f", F.col("__c").alias("cat")).agg(F.coalesce(F.max(F.arrays_overlap(words("want"), words("got")).cast("int")), F.lit(0)).alias("right"))
    right = back.groupBy("cat").agg(F.count("*").alias("found"), F.sum("right").alias("right"))
    out = hit.join(right, F.col("category") == F.col("cat"), "full_outer").select(F.coalesce("category", "cat").alias("category"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("planted", "hit", "found", "right")])
    return out.withColumns({"recall": F.col("hit") / F.nullif("planted", F.lit(0)), "prec": F.col("right") / F.nullif("found", F.lit(0))})
