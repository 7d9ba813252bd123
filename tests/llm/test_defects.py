"""Defective pairs and cut values: held-out accuracy on pairs broken on purpose, and edge cases."""

from __future__ import annotations

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pairs, truncation

SUBJECTS = "The team,A reader,The night crew,The planner,Our archive,The printer,The ferry,A second shop".split(",")
VERBS = "moved,sorted,kept,renamed,copied,checked,counted,repaired".split(",")
THINGS = "the old list of names,the weekly price table,a box of letters,the training deck,every open question,the loan register,a broken lamp".split(",")
ENDS = "before the long weekend,after the second attempt,because the space was short,while the others were away,without asking first".split(",")
GERMAN = ["Der Bericht zeigt die Belege und das Ergebnis der Woche.", "Die Liste wird nach der Prüfung nicht mehr geändert.", "Es ist unklar, ob das Archiv die Fragen noch vor dem Wochenende klärt.", "Das Team hat den Auszug mit der Quelle verglichen."]


#: Wordings that no training text has.
REFUSED = ["I'm sorry, I can't do that for you.", "Sorry, this I will not answer.", "I cannot assist with this text.", "I decline to give a summary of the note.", "Unfortunately I'm not able to look into it.", "As an AI, I won't comment on the list.", "I refuse to write this.", "I am not allowed to share an answer.", "My rules don't let me help with this."]


def sentence(rng: random.Random) -> str:
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(THINGS)} {rng.choice(ENDS)}."


def sound(rng: random.Random) -> tuple[str, str]:
    prompt = f"Summarize the note on {rng.choice(THINGS)} number {rng.randrange(999)} in a few sentences."
    return prompt, " ".join(sentence(rng) for _ in range(rng.randrange(4, 9)))


@pytest.fixture(scope="module")
def broken():
    """(rows, key -> defect or None)."""
    rng = random.Random(17)
    rows, truth = [], {}
    for key in range(900):
        p, r = sound(rng)
        kind = rng.choice([None] * 7 + list(pairs.DEFECTS))
        if kind == "empty":
            r = rng.choice(["", None, "N/A", "```json\n{}\n```", '{"title": "", "bullets": []}', "TITLE:\nABSTRACT:", "​"])
        elif kind == "truncated":
            at = r.index(" ", len(r) // 2) + 3
            while not (r[at - 1].isalpha() and r[at].isalpha()):
                at += 1
            r = r[:at]
        elif kind == "refusal":
            r = rng.choice(REFUSED)
        elif kind == "copied_prompt":
            r = rng.choice([p, p.upper(), "> " + p, "You asked: " + p])
        elif kind == "other_language":
            r = " ".join(rng.choice(GERMAN) for _ in range(6))
        elif rng.random() < 0.2:
            r = p + "\n\n" + r  # restated, then answered
        elif rng.random() < 0.2:
            r = "The desk said: “I cannot help with that.” " + r
        rows.append((key, p, r, "src", None))
        truth[key] = kind
    return rows, truth


SCHEMA = "result_key bigint, prompt string, raw_response string, source string, markdown string"


def test_held_out_accuracy(spark, broken):
    rows, truth = broken
    df = spark.createDataFrame([*rows, *rows[:50]], SCHEMA).withColumn("defect_type", F.lit("clash")).withColumn("continued", F.lit(1))
    got = {r.result_key: r.defect_type for r in pairs.defective(spark, df).collect()}
    for kind in pairs.DEFECTS:
        mine = {k for k, v in got.items() if v == kind}
        true = {k for k, v in truth.items() if v == kind}
        assert len(mine & true) >= 0.9 * len(true), (kind, len(mine & true), len(true))
        assert len(mine & true) >= 0.9 * len(mine), (kind, len(mine & true), len(mine))


def test_tables_without_sound_pairs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pairs.defective(spark, none).count() == 0


def test_content():
    assert pairs.content('```json\n{"title": "A b", "n": [1, "c"]}\n```') == ("A b\n1\nc", True)
    assert pairs.content('{"title": "A \\u00e9", "bul')[0].split()[:2] == ["A", "é"]
    said, is_json = pairs.content("TITLE: x y\n- item")
    assert said.split() == ["x", "y", "item"] and not is_json


TASKS = {
    "en": ["Summarize the note.", "Say in one line what the letter is about.", "Which tasks are left, and who has them?", "Give a title and three points."],
    "de": ["Fasse den Brief kurz zusammen.", "Worum geht es in dem Schreiben?", "Welche Aufgaben bleiben noch übrig?", "Gib einen Titel und drei Punkte an."],
    "fr": ["Résume la lettre et indique les points de désaccord.", "Donne les idées principales de lettre-12.txt sous forme de tableau.", "De quoi parle la note ?", "Quelles tâches restent à faire, et pour qui ?"],
    "es": ["Resume la carta e indica los puntos de desacuerdo.", "Da las ideas principales de carta-12.txt en forma de tabla.", "¿De qué trata la nota?", "¿Qué tareas quedan por hacer, y para quién?"],
}
ASKED = [(" Answer in German.", "de"), (" Antworte auf Französisch.", "fr"), (" Réponds en espagnol.", "es"), (" Responde en inglés.", "en"), ("\nOutput language: Spanish", "es")]


def test_asked_language():
    """Every task of every language, alone and asking for another language; the model knows no text but the frequent words."""
    known = pairs.Languages.fit([])
    for want, tasks in TASKS.items():
        for task in tasks:
            for more, asked in [("", want), *ASKED]:
                assert pairs.LANGUAGES[known.asked(task + more)] == asked, task + more
    assert known.asked("") == -1 and known.asked("12 34") == -1
    assert pairs.LANGUAGES[known.asked("Who gave the French lesson and the German one?")] == "en"


def test_training_texts_are_not_of_the_tables():
    """No longer part of a training sentence stands in the test tables, where these are there."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    columns = [("documents", "text"), ("model_results", "prompt"), ("model_results", "raw_response"), ("model_results", "markdown"), ("text_chunks", "text")]
    texts = "\n".join(v for t, c in columns for v in pq.read_table(f"{folder}/{t}.parquet", columns=[c]).column(0).to_pylist() if v).lower()
    made = [x for parts in pairs.REFUSALS.values() for values in parts for x in values] + pairs.FOREIGN_QUOTE
    made += [x for table in (pairs.TOLD, pairs.TERSE, pairs.CLOSINGS) for values in table.values() for x in values]
    parts = [p.strip(" .…?,").lower() for x in made for p in x.split("{}")]
    assert not [p for p in parts if len(p.split()) >= 5 and p in texts]
    whole = {x.strip().lower() for x in made if "{}" not in x and len(x.split()) >= 2}
    responses = pq.read_table(f"{folder}/model_results.parquet", columns=["raw_response"]).column(0).to_pylist()
    assert not whole & {v.strip().lower() for v in responses if v}


def test_open_json():
    for value, end in [('{"a": "The cat', ("json", "The", "cat")), ('{"a": "x y", "list": ["b", "c"]', ("json", "b", "c")), ('{"a": ["x"], "list": [', ("json", "x", "list")), ('{"a": "say \\"no\\""}', None), ('```json\n["a", "b"]\n```', None), ('{"a":"b","c":"d', ("json", "c", "d"))]:
        assert truncation.open_end(value) == end, value


def test_cut_values(spark):
    rng = random.Random(23)
    rows, truth = [], set()
    for key in range(400):
        style = rng.choice(["prose", "list", "json"])
        parts = [sentence(rng) for _ in range(rng.randrange(3, 8))]
        value = " ".join(parts) if style == "prose" else "\n".join("- " + p[:-1] for p in parts) if style == "list" else '{"title": "' + parts[0] + '", "bullets": ["' + '", "'.join(parts[1:]) + '"]}'
        md = "# Response\n\n" + value
        if rng.random() < 0.2:
            at = rng.randrange(len(value) // 2, len(value) - 8)
            while not (value[at - 1].isalpha() and value[at].isalpha()):
                at -= 1
            value = value[:at] + rng.choice(["", "…", "\n"])
            truth.add((key, "raw_response"))
        rows.append((key, rng.choice(["a", "b", None]), value, md))
    rows += [(1000, "a", "", None), (1001, "a", None, " "), (1002, None, "42", "n = 17"), (1003, "a", "TITLE:\nABSTRACT:", "x"), (1004, "a", "All of it was kept. And so on…", None)]
    df = spark.createDataFrame([*rows, *rows[:20]], "result_key bigint, source string, raw_response string, markdown string").selectExpr("*", "'x' as word", "1 as length")
    got = {(r.result_key, r.field_name) for r in truncation.truncated(df).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got), (len(got), len(truth), len(got & truth), sorted(got - truth)[:3], sorted(truth - got)[:3])
    shares = {(r.source, r.field_name): r for r in truncation.rates(df).collect()}
    assert sum(r.n_cut for r in shares.values()) == len(got)
    assert sum(r.n_values for r in shares.values()) == sum(v is not None for row in rows for v in row[2:])
    assert truncation.truncated(df.limit(0)).count() == 0


def test_a_source_with_a_field_limit(spark):
    rng = random.Random(29)
    rows = []
    for key in range(300):
        value = "\n".join("- " + sentence(rng)[:-1] for _ in range(9))
        rows.append((key, "short" if key % 3 == 0 else "long", value[:300] if key % 3 == 0 else value, None))
    df = spark.createDataFrame(rows, "result_key bigint, source string, raw_response string, markdown string")
    got = {r.result_key for r in truncation.truncated(df).collect()}
    assert len(got & {k for k in range(0, 300, 3)}) >= 95 and not [k for k in got if k % 3]


def test_chance_lengths_are_no_limits(spark):
    """Cut lengths that meet by chance, as they do in a large source, are no limit; a pile on one length is."""
    rng = random.Random(31)
    rows, cuts = [], set()
    for key in range(3000):
        value = "\n".join("- " + sentence(rng)[:-1] for _ in range(rng.randrange(3, 8)))
        if key % 3 == 0:
            at = 330 if key % 30 == 0 and len(value) > 330 else rng.randrange(len(value) // 2, len(value) - 8)
            while at != 330 and not (value[at - 1].isalpha() and value[at].isalpha()):
                at -= 1
            value = value[:at]
            cuts.add(key)
        rows.append((key, "hot", value, None))
    df = spark.createDataFrame(rows, "result_key bigint, source string, raw_response string, markdown string")
    got = {r.result_key for r in truncation.truncated(df).collect()}
    assert len(got - cuts) <= 0.02 * len(got), (len(got - cuts), len(got))
    assert len(got & cuts) >= 0.9 * len(cuts), (len(got & cuts), len(cuts))
    piled = {k for k, _, v, _ in rows if len(v) == 330 and k in cuts}
    assert len(piled) > 30 and len(got & piled) >= 0.98 * len(piled), (len(got & piled), len(piled))


def test_copies_of_a_cut_value_do_not_vouch_for_each_other(spark):
    """A third of all rows are copies of one cut value, its markdown cut at the same place."""
    rng = random.Random(37)
    rows = [(key, "a", " ".join(sentence(rng) for _ in range(5)), None) for key in range(400)]
    rows += [(500 + i, "a", sentence(rng) + " The potter glazed a cranberry bowl " + rng.choice(ENDS) + ".", None) for i in range(5)]
    value = " ".join(sentence(rng) for _ in range(3)) + " The potter glazed a cran"
    rows += [(1000 + i, f"s{i % 7}", value, "# Response\n\n" + value) for i in range(200)]
    rows += [(2000 + i, "a", "n = 17", "# Response\n\nn = 17") for i in range(20)]
    rows += [(3000 + i, "a", f"It has {i} rows and more of them.", None) for i in range(20)]
    df = spark.createDataFrame(rows, "result_key bigint, source string, raw_response string, markdown string")
    got = {(r.result_key, r.field_name) for r in truncation.truncated(df).collect()}
    assert got == {(1000 + i, f) for i in range(200) for f in truncation.FIELDS}


def test_made_ends_are_only_looked_up(spark):
    """A made cut sees the corpus without its original, and the held-out part shares no pair with the training part."""
    rows = [(i, "a", f"Report {i} lists the open tasks of the week. It was kept.", None) for i in range(20)]
    whole = "The archive keeps a zebrawood cabinet. It was kept."
    rows += [(100 + i, "a", whole, None) for i in range(3)]
    df = spark.createDataFrame(rows, "result_key bigint, source string, raw_response string, markdown string")
    schema = "result_key bigint, kind string, context string, word string, " + ", ".join(f"{c} bigint" for c in truncation.OWN)
    cuts = [("The archive keeps a zebraw", whole), (rows[0][2][:32], rows[0][2])]
    ends = [(-1 - i, *truncation.open_end(v), *truncation.own_counts(v, o)) for i, (v, o) in enumerate(cuts)]
    assert {r.result_key for r in truncation.truncated(df, spark.createDataFrame(ends, schema)).collect()} == {-2}
    made = pairs.examples(pairs.Languages.fit([]), [sound(random.Random(i)) for i in range(60)])
    held = [m for m in made[:-6 * (len(pairs.EMPTIES) + 1)] if m[3] % 5 == 0]
    assert {m[0] for m in held if m[2] >= 0} <= {sound(random.Random(i))[0] for i in range(0, 60, 5)}
