"""Registered text queries over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.text import clean_text
from sitelens.operators import words as Wd
from sitelens.sources.tables import documents

# Test stand-in: the driver's documents contain no navigation boilerplate, so
# ``nav_noise`` appends one of these lines (chosen by doc_id) to each
# document before cleaning. The last entry adds nothing.
NOISE_LINES = [
    "\nГлавная О нас Услуги Контакты",
    "\n© 2023 Все права защищены",
    "\nCookie согласие принято",
    "\nПолитика конфиденциальности",
    "\nHOME  About Services CONTACT",
    "\nМеню | Каталог",
    "\nПользовательское соглашение",
    "",
]


def noisy_documents(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array(*[F.lit(x) for x in NOISE_LINES])
    idx = F.pmod(F.col("doc_id"), F.lit(len(NOISE_LINES))).cast("int")
    return documents(spark, sf).select("doc_id", F.concat("text", F.element_at(lines, idx + 1)).alias("text"))


def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", clean_text("text").alias("text_out"))


def nav_noise(spark: SparkSession, sf: str) -> DataFrame:
    return Wd.remove_navigation_noise(noisy_documents(spark, sf))


def frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    return Wd.frequent_words(documents(spark, sf))


def drop_frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    return Wd.drop_frequent_words(documents(spark, sf))


QUERIES = {
    "text_clean": text_clean,
    "nav_noise": nav_noise,
    "frequent_words": frequent_words,
    "drop_frequent_words": drop_frequent_words,
}
