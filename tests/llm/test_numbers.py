"""Numbers of templates: found by first letters, the same places as by the plain list of words."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftgraph.llm import op1_decontaminate as O

PLAIN = rf"(?:[0-9](?<![\p{{L}}\p{{N}}].)[0-9]*(?:[.,:/][0-9]+)*|(?<![\p{{L}}\p{{N}}])(?i:{O.NUMBER_WORDS})(?![\p{{L}}\p{{N}}]))"


def test_numbers_are_found_where_the_plain_pattern_finds_them(spark):
    draw = random.Random(4)
    parts = [*O.NUMBER_WORDS.split("|"), "Six", "SIXTEEN", "one's", "tone", "onee", "é", "7", "3.5", "1,000", "12:30", "x9", "9x", "四", "²", "-", " ", " ", " ", "\n", ".", "_", "😀"]
    rows = spark.createDataFrame([("".join(draw.choice(parts) for _ in range(draw.randint(0, 25))),) for _ in range(3_000)] + [(None,)], "text string")
    replaced = lambda p: F.regexp_replace("text", p, "<N>")
    assert rows.where(~replaced(O.NUMBER).eqNullSafe(replaced(PLAIN))).count() == 0
    assert rows.where(~F.regexp_extract_all("text", F.lit(f"({O.NUMBER})")).eqNullSafe(F.regexp_extract_all("text", F.lit(f"({PLAIN})")))).count() == 0
    assert rows.where(replaced(O.NUMBER) != F.col("text")).count() > 1_000


def test_a_place_that_is_no_number_is_left_at_its_first_letter():
    assert O.NUMBER.startswith("[0-9")  # a list of all words is not tried at every word
