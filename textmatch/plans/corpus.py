"""Building the corpus from the person tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.config import EngineConfig, materialize
from textmatch.functions.text import clean_text, clean_title_text, first_of_list
from textmatch.functions.titles import standardize_title
from textmatch.operators.relational import (
    clean_columns,
    content_dedup,
    filter_max_id,
    group_concat_distinct,
    require_columns,
)

# Columns that never reach the corpus.
CONTACT = ["name", "email", "phone", "linkedin"]
EMPLOYMENT = ["firm", "start_date", "end_date", "location"]


def text_representation(
    ability: Column, title: Column, skill: Column, repeat: int = 3, sep: str = ""
) -> Column:
    """``ability | titles | skill``; the title is repeated, by default without a blank."""
    titles = F.array_join(F.array_repeat(clean_title_text(title), repeat), sep)
    return F.concat_ws(" | ", clean_text(ability), titles, clean_text(skill))


def join_profiles(
    people: DataFrame,
    abilities: DataFrame,
    experience: DataFrame,
    skills: DataFrame,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """``(person_id, ability, title, skill)`` per person, before de-duplication.

    The detail tables carry ``seq``, the order in which their rows were listed. Each is
    reduced to one row per person before it is joined.
    """
    require_columns(people, ["person_id"])
    out = filter_max_id(clean_columns(people).drop(*CONTACT), cfg.max_person_id)
    details = [(abilities, "ability"), (experience, "title"), (skills, "skill")]
    for table, column in details:
        require_columns(table, ["person_id", column, "seq"])
        table = filter_max_id(
            clean_columns(table.drop(*EMPLOYMENT), keep=("person_id", "seq")),
            cfg.max_person_id,
        )
        if column == "title":
            table = table.withColumn("title", first_of_list(F.col("title")))
        grouped = group_concat_distinct(table, "person_id", [column], ["seq"])
        out = out.join(grouped, "person_id", "left")
    return out


def prepare_corpus(
    people: DataFrame,
    abilities: DataFrame,
    experience: DataFrame,
    skills: DataFrame,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """``(person_id, ability, title, skill, embedding_text)``, one row per content."""
    # Read twice, for the digests and for the rows that stay: grouped and joined once.
    profiles = materialize(join_profiles(people, abilities, experience, skills, cfg), "profiles")
    profiles = content_dedup(profiles)
    filled = profiles.select(
        "person_id",
        F.coalesce("ability", F.lit("Unknown ability")).alias("ability"),
        standardize_title(F.col("title")).alias("title"),
        F.coalesce("skill", F.lit("Unknown skill")).alias("skill"),
    )
    text = text_representation(
        F.col("ability"), F.col("title"), F.col("skill"), cfg.title_repeat, cfg.title_sep
    )
    return filled.withColumn("embedding_text", text)
