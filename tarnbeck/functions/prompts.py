"""Prompts and condition hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, plain, text

RUNGS = ("L1", "L2", "L3", "L4")


def at_least(rung: Column, least: str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, RUNGS)), rung) >= RUNGS.index(least) + 1, F.lit(False))


def prompt(rung: Column, question: Column, files: Column, l2: Column, l3: Column, program: Column) -> Column:
    """Cumulative prompt of a rung: question and files, then where to look, then the method, then a program; missing blocks are left out."""
    block = lambda title, c: F.when(F.trim(text(c)) != "", F.concat(F.lit(f"{title}\n"), c))
    listed = F.array_join(F.transform(files, lambda f: F.concat(F.lit("- "), f)), "\n")
    return F.concat_ws(
        "\n\n", question, block("Files:", listed), F.when(at_least(rung, "L2"), block("Where to look:", l2)), F.when(at_least(rung, "L3"), block("Method:", l3)),
        F.when(at_least(rung, "L4"), block("A program to start from:", program)),
    )


def hint_source(rung: Column, hint: Column, program: Column) -> Column:
    """none, fixed, llm or ast: where the help of a rung comes from."""
    return F.when(rung == "L1", "none").when(rung == "L4", "fixed").when(F.trim(text(hint)) != "", "llm").when(F.trim(text(program)) != "", "ast").otherwise("none")


def hint_text(l2: Column, l3: Column) -> Column:
    """A hint's fields as one text: the places in order of their names, then the method."""
    places = F.transform(F.array_sort(F.map_entries(l2)), lambda e: F.concat(e["key"], F.lit(": "), text(e["value"])))
    return F.concat_ws("\n", F.array_join(F.coalesce(places, F.array().cast("array<string>")), "\n"), F.nullif(text(l3), F.lit("")))


def files_line(files: Column, limit: int = 6) -> Column:
    """The first names, and how many there are in all if some are left out."""
    shown = F.array_join(F.slice(files, 1, limit), ", ")
    return F.when(F.size(files) > limit, F.concat(shown, F.lit(", ... ("), F.size(files).cast("string"), F.lit(" total)"))).otherwise(shown)


def condition_sha(prompt: Column, settings: Column) -> Column:
    """sha256 of a prompt, and of its settings (map<string,string>) in the order of their names where there are any."""
    ordered = F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return F.when(F.coalesce(F.size(settings), F.lit(0)) > 0, F.sha2(F.concat(prompt, F.lit("\n"), ordered), 256)).otherwise(F.sha2(prompt, 256))


def hint_problems(columns: Column, real_columns: Column, files: Column, real_files: Column, l2: Column, l3: Column, answer_leaks: Column) -> Column:
    """Why a hint is refused, in order: nothing real left, a method that says no more, the answer in it; empty if it is fine."""
    real = lambda names, known: F.filter(names, lambda c: F.exists(known, lambda k: plain(k) == plain(c)))
    return compact(
        F.when((F.size(real(columns, real_columns)) == 0) & (F.size(real(files, real_files)) == 0), F.lit("names nothing that is there")),
        F.when((F.trim(text(l3)) == "") | (plain(l2) == plain(l3)), F.lit("method adds nothing")),
        F.when(F.size(answer_leaks) > 0, F.lit("gives the answer")),
    )
