"""What the model is asked: the task, the shape of its answer and the text, as columns (system, user).

The labels and tags are those that functions.parsing reads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# The line before the text, and the labels and tags of answers.
CONTENT = "\nFile content:\n"
SHAPE = "TITLE: <a few words>\nABSTRACT: <two or three sentences>\nKEY POINTS:\n- <one point a line>\nOPEN QUESTIONS:\n- <one question a line, or None>\n"
CONFIDENCE = "CONFIDENCE: low|medium|high\n"
TAGGED = {"evidence": "<TYPE> | <statement> | <exact passage, if there is one>\n", "entities": "ENTITY | <kind> | <name> | <key=value; key=value> | <exact passage>\nLINK | <address> | <label> | <exact passage>\n"}


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _asked(instructions: str) -> str:
    return f"The caller also asks: {instructions.strip()}\n" if instructions.strip() else ""


def _system(text: str, guidance: str) -> Column:
    return F.lit(text + (f"\n\nGuidance: {guidance.strip()}" if guidance.strip() else ""))


def snippets(wanted: Column, most_chars: int) -> Column:
    """The request for verbatim passages; empty where none are wanted."""
    shape = f"SOURCE SNIPPETS:\n- TEXT: <a passage of the file, word for word, at most {most_chars} characters>\n  REASON: <what it is good for>\n"
    rule = "Give up to %d source snippets: main claims, examples, definitions and caveats, copied exactly; leave out titles, links and lists of references. Give none if nothing fits.\n"
    return F.when(wanted > 0, F.concat(F.lit(shape), F.format_string(rule, wanted))).otherwise("")


def summarize(path: Column, content: Column, wanted: Column, most_chars: int, instructions: str = "", guidance: str = "") -> Column:
    """struct<system, user> for a summary of a file or of one chunk of it."""
    user = _lines("Summarize this file.\nPath: ", path, "\n" + _asked(instructions) + "Answer in exactly this shape:\n" + SHAPE, snippets(wanted, most_chars), CONFIDENCE, CONTENT, content)
    return F.struct(_system("You summarize files. Say only what the file says, show no reasoning, and answer with labelled text.", guidance).alias("system"), user.alias("user"))


def extract(path: Column, content: Column, preset: str, most_items: int, most_chars: int, focus: str = "", guidance: str = "") -> Column:
    """struct<system, user> for items of a preset's types as tagged lines."""
    types = ", ".join(sorted(T.PRESETS[preset]))
    kinds = {"entities": TAGGED["entities"], "research": TAGGED["evidence"] + TAGGED["entities"]}.get(preset, TAGGED["evidence"])
    task = f"\nPreset: {preset}\nAllowed types: {types}\n" + (f"Focus: {focus.strip()}\n" if focus.strip() else "")
    rules = f"Give at most {most_items} items, one a line, or none if the file has none. Passages are copied exactly, at most {most_chars} characters.\nShapes of a line:\n{kinds}"
    user = _lines("Path: ", path, task + rules, CONTENT, content)
    return F.struct(_system("You extract items that a file states. Use only what is in the file, show no reasoning, and answer with tagged lines.", guidance).alias("system"), user.alias("user"))


def reduce(path: Column, summaries: Column, n: Column, instructions: str = "", guidance: str = "") -> Column:
    """struct<system, user> for one summary of the rendered summaries of a file's chunks."""
    content = _lines("Source path: ", path, F.format_string("\nChunk summaries: %d\n\nMake one summary of the file from these, using nothing else.\n\n", n), summaries)
    return summarize(path, content, F.lit(0), 0, instructions, guidance)


def prompt(path: Column, content: Column, instructions: str, guidance: str = "") -> Column:
    """struct<system, user> for the caller's own instructions on a file."""
    user = _lines("Path: ", path, f"\nInstructions: {instructions}\n", CONTENT, content)
    return F.struct(_system("You work on files offline. Do with the file what the instructions say.", guidance).alias("system"), user.alias("user"))
