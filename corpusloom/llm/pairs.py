"""Problem 3: prompt-response pairs that do not serve as an answer, with the kind of their defect.

A multi-label linear classifier: one linear model per defect over hashed n-grams of the response and features of the pair
(languages asked for and found, overlap with the prompt, what content is left without labels and markup, how the response
ends).  It is trained where it runs, on a bounded sample of the pairs (about TRAINING_PAIRS, twice that at most): pairs that look sound are kept as
they are, and each is also broken on purpose - cut off, replaced by its prompt, swapped with a response in another language,
emptied, or refused - or varied harmlessly (prompt restated before the answer, a refusal only told of, a terse answer).
A held-out part, of other pairs and other wordings, sets each model's threshold where the F1 measure is best.  Then the sample's own
pairs of which the model is sure (refusals, and pairs without a defect) are added and it is fitted on all of them, twice.

Languages are told by a naive Bayes model over the letter n-grams of words, fitted on the sample's texts; those of which the
frequent words of one language make up most say what each language looks like.

How an open end is continued elsewhere in the corpus (llm.truncation, over all pairs) is one of the features.  The sample's
made responses are only looked up there, each against the corpus without the response that it was made of.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import truncation
from corpusloom.session import cut, distinct_rows, small

DEFECTS = ("empty", "truncated", "refusal", "copied_prompt", "other_language")
#: Pairs that the classifier is trained on, taken by the hash of their keys.
TRAINING_PAIRS = 3_000
#: Hashed dimensions of the classifier and of the language model.
HASHED = 1 << 14
LETTERS = 1 << 15
EPOCHS, BATCH = 14, 512
SEED = 7
#: How far above its threshold, or below all of them, a score of the sample's own pairs must be for them to be trained on.
SURE, SURELY_SOUND = 1.0, 1.5
#: How often they are added.
ROUNDS = 2

LANGUAGES = ("en", "de", "fr", "es")
# Frequent words, language names, placeholders and labels by language.
FREQUENT = {
    "en": "the of and to in is was for that with on as it by at from which are this not be were but have has or an a their its what who when while because although so if no more than after before until only one two also they there here every during its once still both each will would can cannot should into over under between without within did does do you your me my we our i us he she his her",
    "de": "der die das und ist nicht ein eine einen einem einer des dem den mit auf für von zu im in am wird wurde werden auch aus bei nach noch nur sich als oder aber wie was wenn weil da dass es sie er wir ich über unter vor zwischen ohne bis seit beim zum zur kein keine beides sind hat haben war waren ob so damit obwohl während ihr sein an um mir uns welche warum",
    "fr": "le la les de des du un une et est dans pour que qui ne pas par sur avec ce cette ces sont au aux plus ou mais se sa son ses leur il elle ils nous vous on été en encore entre sans selon après avant lorsque afin si personne car alors a ont était je à d l qu n s c j y tu mes votre quelles pourquoi",
    "es": "el la los las de un una unos y e es en para que no por con su sus se lo del al más pero como está este esta estos son fue han ha ya todavía entre sin según hasta desde después antes porque aunque nadie si ambas cuando ser muy o sobre también dos sí a cual qué yo mi le les sea cuáles",
}
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles",
    "de": "german deutsch allemand alemán aleman",
    "fr": "french französisch francais français francés frances",
    "es": "spanish spanisch espagnol español espanol",
}
# Words that stand before the name of a language where an answer in it is asked for.
ASKING = frozenset("in into en auf ins language langue sprache idioma lengua using".split())
PLACEHOLDERS = "none n/a na null nil undefined untitled unknown tbd todo empty keine keiner nichts ninguna ninguno aucune aucun rien nada unbenannt sin título sans titre no open questions keine offenen fragen aucune question ouverte ninguna pregunta abierta nothing listed not available no answer no content no response confidence high medium low hoch mittel niedrig response title abstract key points open questions answer summary antwort réponse respuesta titel zusammenfassung résumé resumen titre título"
LABEL = re.compile(r"^[ \t>#*_]*(?:[A-ZÄÖÜÉ][\wÀ-ÿ' ]{0,24}):[*_ \t]*", re.M)
HEADING = re.compile(r"^[ \t]*#{1,6}[ \t].*$", re.M)
MARKUP = re.compile(r"<[^<>\n]{0,80}>|```\w*|[​-‏⁠﻿­]|^[ \t]*(?:[-*+•>]|\d+[.)])(?=\s|$)|\[/?\w+\]|\{\{?\w*\}?\}", re.M)
QUOTED = re.compile(r"„[^“”\n]{1,400}[“”]|“[^”\n]{1,400}”|«[^»\n]{1,400}»|‚[^‘\n]{1,200}‘|(?<![\w\"])\"[^\"\n]{1,400}\"")
NOT_AVAILABLE = re.compile(r"\bn/a\b", re.I)
QUOTE = re.compile("[\"„“«‚]")
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
OTHER_SCRIPT = re.compile("[\u0370-\u1dff\u2c00-\ud7ff\uf900-\ufdff\U00010000-\U0003ffff]")
ESCAPED = re.compile(r"\\u[0-9a-fA-F]{4}")
TASK_END = re.compile(r"\n\s*\n")
PAIR_STRINGS = re.compile(r'"((?:[^"\\]|\\.)*)"?\s*(:?)')

_PLACE = set(PLACEHOLDERS.split())
_NAMED = {n: i for i, l in enumerate(LANGUAGES) for n in LANGUAGE_NAMES[l].split()}  # noqa: E741
_SEEDS = {l: frozenset(FREQUENT[l].split()) for l in LANGUAGES}  # noqa: E741


def strings(value: object) -> Iterator[str]:
    """The texts of a JSON value, without keys."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield str(value)
    elif isinstance(value, list):
        for x in value:
            yield from strings(x)
    elif isinstance(value, dict):
        for x in value.values():
            yield from strings(x)


def content(response: str) -> tuple[str, bool]:
    """(what a response says, without keys, labels and markup; whether it is JSON)."""
    s = response.strip()
    body = re.sub(r"\A```\w*\s*|\s*```\Z", "", s)
    if body[:1] in "{[" and len(body) > 1:
        try:
            return "\n".join(strings(json.loads(body))), True
        except ValueError:
            if body[:1] == "{" or body[1:2] in '{"':
                parts = [a for a, colon in PAIR_STRINGS.findall(body) if not colon]
                text = "\n".join(parts).replace("\\n", "\n").replace('\\"', '"')
                return ESCAPED.sub(lambda m: chr(int(m.group()[2:], 16)), text), True
    if "#" in s and "\n" in s:
        s = HEADING.sub("", s)
    if ":" in s:
        s = LABEL.sub("", s)
    return MARKUP.sub(" ", s), False


def _letters(word: str) -> np.ndarray:
    """Hashed letter n-grams (1 to 4) of a word with its edges."""
    w = f"^{word}$".encode("utf-8", "replace")
    return np.array([zlib.crc32(w[i : i + n]) % LETTERS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)], np.int64)


def _seeded(words: list[str]) -> int | None:
    """The language whose frequent words stand out among the words, or None."""
    n = sorted(((sum(map(_SEEDS[l].__contains__, words)), i) for i, l in enumerate(LANGUAGES)), reverse=True)  # noqa: E741
    return n[0][1] if n[0][0] >= 3 and n[0][0] >= 1.6 * n[1][0] else None


class Languages(dict):
    """A naive Bayes model of languages and what it has seen of words: word -> place in hashes, votes and evidence.

    evidence is the logarithm of a word's probability in each language, less their mean; votes are its shares by language.
    Words with a digit tell nothing and have no votes.  What is held of words is cleared at a number of words per worker.
    """

    HELD = 400_000

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table
        self.tasks: dict[str, int] = {}
        self._grow(4096)

    def _grow(self, n: int) -> None:
        k = len(self)
        for name, width, kind in (("hashes", (), np.int64), ("votes", (4,), np.float32), ("evidence", (4,), np.float32)):
            new = np.zeros((n, *width), kind)
            if k:
                new[:k] = getattr(self, name)[:k]
            setattr(self, name, new)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= len(self.hashes):
            self._grow(2 * i)
        self[word] = i
        self.hashes[i] = zlib.crc32(word.encode("utf-8", "replace"))
        if not truncation._DIGIT.search(word):
            e = self.table[_letters(word)].sum(axis=0)
            self.evidence[i] = np.clip(e, e.max() - 8, None) - e.mean()
            v = np.exp(np.clip(e - e.max(), -8, 0))
            self.votes[i] = v / v.sum()
        return i

    def trim(self) -> None:
        if len(self) > self.HELD:
            self.clear()
        if len(self.tasks) > self.HELD // 20:
            self.tasks.clear()

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def counts(self, words: list[str]) -> np.ndarray:
        """Words of each language, a word of several languages in parts."""
        return self.votes[self.ids(words)].sum(axis=0)

    def of(self, words: list[str]) -> int:
        """The language of words, or -1 if two are about as likely."""
        if not words:
            return -1
        e = self.evidence[self.ids(words)].sum(axis=0)
        a, b = np.sort(e)[-1], np.sort(e)[-2]
        return int(e.argmax()) if a - b >= 1 else -1

    def asked(self, prompt: str) -> int:
        """The language that a prompt asks for or, if it names none, its task is written in, then its whole text; -1 if unknown."""
        said = TASK_END.split(prompt, maxsplit=1)[0]
        if said not in self.tasks:
            task = WORDS.findall(said.lower())
            named = [_NAMED[b] for a, b in zip(task, task[1:]) if b in _NAMED and a in ASKING]
            self.tasks[said] = named[-1] if named else self.of(task)
        found = self.tasks[said]
        return found if found >= 0 else self.of(WORDS.findall(prompt.lower()))

    @classmethod
    def fit(cls, texts: Iterable[str]) -> Languages:
        """From texts, each in the language of its frequent words, and those words themselves."""
        words = [Counter({w: 3 for w in _SEEDS[l]}) for l in LANGUAGES]  # noqa: E741
        for text in texts:
            found = WORDS.findall(text.lower())
            k = _seeded(found)
            if k is not None:
                words[k].update(found)
        table = np.full((LETTERS, len(LANGUAGES)), 0.3)
        for k, counted in enumerate(words):
            for w, n in counted.items():
                if not truncation._DIGIT.search(w):
                    np.add.at(table[:, k], _letters(w), np.log1p(n))
        table = np.log(table / table.sum(axis=0))
        return cls((table - table.mean(axis=1, keepdims=True)).astype(np.float32))


DENSE = (
    "bias", "null", "no_content", "few_content", "words_1_4", "words_5_12", "words_13_30", "words_31_60", "words_61_150", "words_over_150", "json", "json_broken",
    "open_stops", "open_plain", "open_alone", "open_json", "open_lost", "continued", "continued_loose", "open_not_continued", "dots_not_continued", "ends_stop", "ends_letter", "ends_dots",
    "in_prompt", "in_prompt_90", "in_prompt_short", "of_task", "of_task_in_prompt", "longer_than_prompt", "language_known", "expected_share", "other_share", "language_gap", "language_other",
    "other_script", "quoted_share", "first_person", "negation", "first_person_negation", "negation_short", "digit_short",
)
SIZE = len(DENSE) + HASHED
_AT = {name: i for i, name in enumerate(DENSE)}
_SIZES = (("words_1_4", 1, 4), ("words_5_12", 5, 12), ("words_13_30", 13, 30), ("words_31_60", 31, 60), ("words_61_150", 61, 150), ("words_over_150", 151, 10**9))
# Words for oneself and words that negate, of the four languages.
FIRST_PERSON = frozenset("i ich je j me my i'm i’m i'd i’d i'll i’ll mich mir meine yo mi mis me mon ma mes".split())
NEGATION = frozenset("not no never cannot can't can’t won't won’t don't don’t unable decline declined refuse refused denied nicht kein keine nichts ne n pas aucun aucune rien refuse ni ningún ninguna nada niego".split())


def features(words_of: Languages, prompt: str | None, response: str | None, continued: bool) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a pair's features."""
    prompt = prompt or ""
    words_of.trim()
    d = np.zeros(len(DENSE))

    def put(name: str, value: float = 1.0) -> None:
        d[_AT[name]] = value

    put("bias")
    idx, val = [], []
    if response is None:
        put("null")
        put("no_content")
    else:
        said, is_json = content(response)
        if "/" in said:
            said = NOT_AVAILABLE.sub(" ", said)
        unquoted = said if is_json or not QUOTE.search(said) else QUOTED.sub(" ", said)
        words = WORDS.findall(said.lower())
        own = words if unquoted is said else WORDS.findall(unquoted.lower())
        left = [w for w in words if w not in _PLACE]
        n = len(left)
        put("no_content", n == 0)
        put("few_content", n <= 3)
        for name, low, high in _SIZES:
            if low <= n <= high:
                put(name)
        end = truncation.open_end(response)
        s = response.rstrip()
        put("json", is_json)
        put("json_broken", is_json and end is not None)
        put("continued", continued)
        if end:
            put("open_" + end[0])
            put("continued_loose", continued and end[0] in ("plain", "alone"))
            put("open_not_continued", not continued)
        dots = s.endswith(("…", "..."))
        put("dots_not_continued", dots and not continued)
        put("ends_dots", dots)
        put("ends_stop", s[-1:] in ".!?。؟")
        put("ends_letter", s[-1:].isalpha())
        # Overlap with the prompt.
        p_words = WORDS.findall(prompt.lower())
        if left and p_words:
            p_set = set(p_words)
            inside = sum(map(p_set.__contains__, left)) / n
            short = n <= 1.3 * len(p_words) + 4
            task = set(WORDS.findall(TASK_END.split(prompt, maxsplit=1)[0].lower()))
            of_task = len(task.intersection(left)) / len(task) if task else 0.0
            put("in_prompt", inside)
            put("in_prompt_90", inside >= 0.8)
            put("of_task", of_task)
            put("longer_than_prompt", not short)
            if short:
                put("in_prompt_short", inside)
                put("of_task_in_prompt", of_task * inside)
        if own:
            at = words_of.ids(own)
            # Languages.
            want = words_of.asked(prompt)
            if want >= 0:
                found = words_of.votes[at].sum(axis=0)
                foreign = 0.0 if unquoted.isascii() else len(OTHER_SCRIPT.findall(unquoted)) / len(unquoted)
                total = float(found.sum())
                put("other_script", foreign > 0.5)
                if total >= 1:
                    mine = float(found[want])
                    other = max(x for i, x in enumerate(found.tolist()) if i != want)
                    sure = min(1.0, total / 6)  # a few words tell less
                    put("language_known", sure)
                    put("expected_share", sure * mine / total)
                    put("other_share", sure * other / total)
                    put("language_gap", sure * (other - mine) / total)
                    put("language_other", sure * (other > mine))
            put("quoted_share", 1 - len(own) / max(1, len(words)))
            # Who speaks, and whether it is denied.
            own_set = set(own[:40])
            i_say, denied = not own_set.isdisjoint(FIRST_PERSON), not own_set.isdisjoint(NEGATION)
            put("first_person", not FIRST_PERSON.isdisjoint(own[:10]))
            put("negation", denied)
            if len(own) <= 40:
                put("first_person_negation", i_say and denied)
                put("negation_short", denied)
                put("digit_short", any(map(str.isdigit, own)))
            # Hashed n-grams of the whole text: words and pairs, apart for short and long responses.
            size = 1 if len(own) <= 40 else 2
            h = words_of.hashes[at]
            grams = (np.concatenate([h, (h[:-1] * 1000003 + h[1:]) & 0x7FFFFFFF]) * 31 + size) % HASHED
            idx.append(grams + len(DENSE))
            val.append(np.full(len(grams), (2.0 if size == 1 else 1.0) / np.sqrt(len(grams))))
            first = h[:6]
            idx.append((first * 131 + np.arange(len(first)) * 17 + size * 7) % HASHED + len(DENSE))
            val.append(np.full(len(first), 0.4))
    on = np.flatnonzero(d)
    return np.concatenate([on, *idx]), np.concatenate([d[on], *val])


class Linear:
    """One linear model per defect, with its threshold."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def scores(weights: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        return np.add.reduceat(weights[index] * value[:, None], np.cumsum([0, *[len(r[0]) for r in rows[:-1]]]), axis=0)

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, held: np.ndarray | None = None, thresholds: np.ndarray | None = None) -> Linear:
        """labels: defect number of each row, -1 for none.  The rows that are held out set the thresholds; if thresholds are
        given, all rows are trained on.  Logistic losses, steps of Adagrad over batches."""
        y = (labels[:, None] == np.arange(len(DEFECTS))[None, :]).astype(float)
        held = np.zeros(len(rows), bool) if held is None else held
        order = np.random.default_rng(SEED).permutation(np.flatnonzero(~held))
        batches = []
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            sizes = [len(rows[i][0]) for i in part]
            index, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            batches.append((index, value, np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(part)), sizes), y[part]))
        n = len(DEFECTS)
        weights, square = np.zeros((SIZE, n)), np.full((SIZE, n), 1e-3)
        for _ in range(EPOCHS):
            for index, value, starts, of, target in batches:
                margin = np.add.reduceat(weights[index] * value[:, None], starts, axis=0)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / len(target)
                slope = np.bincount((index[:, None] * n + np.arange(n)).ravel(), (error[of] * value[:, None]).ravel(), SIZE * n).reshape(SIZE, n) + 2e-5 * weights
                square += slope**2
                weights -= 0.25 * slope / np.sqrt(square)
        if thresholds is None:
            thresholds = np.zeros(n)
            truth, scored = y[held], cls.scores(weights, [rows[i] for i in np.flatnonzero(held)]) if held.any() else np.zeros((0, n))
            for k in range(n if len(truth) else 0):
                order = np.argsort(-scored[:, k])
                hits = np.cumsum(truth[order, k])
                f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, truth[:, k].sum()))
                best = int(f1.argmax())
                low = scored[order[best + 1], k] if best + 1 < len(order) else scored[order[best], k] - 1
                # Never above even odds, as made pairs are told apart more easily than real ones, nor far below.
                thresholds[k] = np.clip((scored[order[best], k] + low) / 2, -0.25, 0.0)
        return cls(weights.astype(np.float32), thresholds)

    def defects(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[str | None]:
        """The defect that passes its threshold by most, or None."""
        over = self.scores(self.weights, rows) - self.thresholds
        best = over.argmax(axis=1)
        return [DEFECTS[k] if over[i, k] > 0 else None for i, k in enumerate(best)]


# Sentences of which refusals, told refusals and terse answers for training are put together: openings, cores, what
# is refused, closings.  Every fourth of each is kept for the held-out part.
REFUSALS = {
    "en": (
        ["", "", "I'm sorry, but ", "", "Sorry, but ", "Unfortunately, ", "My apologies, but ", "I'm afraid ", "Thanks for asking, but ", "Regrettably, "],
        ["I can't {}", "I cannot {}", "I won't {}", "I'm unable to {}", "I will not {}", "I am in no position to {}", "I have to decline to {}", "I must refuse to {}", "I'd prefer not to {}", "I would rather not {}", "I'm not allowed to {}", "I am not permitted to {}",
         "as an AI model I can't {}", "my rules keep me from doing this", "it isn't appropriate for me to {}", "I can't comply", "this can't be fulfilled", "the request has been refused", "request refused", "declined", "I decline", "I refuse", "no comment from me", "I have nothing to say about it",
         "a summary is out of the question", "someone else will have to do it", "this lies outside what I do", "it is not a task for me", "I am the wrong assistant for it", "I would feel uneasy doing so", "I'm going to pass", "I choose not to respond", "I stop here, as the content is restricted", "I leave this unanswered", "access to the subject is denied", "I do not want to {}"],
        ["help with that", "do this", "answer this", "summarize the text", "go on", "discuss the document", "provide that information", "work on the file", "write about the passage", "carry out your instruction", "give you an overview", "review it"],
        ["", "", "", "", ". Is there anything else you need?", ". Feel free to send me something different", ". I recommend asking an expert", ", because it may contain confidential details", ", since that would break the rules", " for safety reasons", ". Thanks for your understanding", ". Please talk to whoever wrote it", ". Let me know if another subject would be useful", " right now", " under these conditions"],
    ),
    "de": (
        ["", "", "Tut mir leid, ", "", "Bedaure, ", "Leider ", "Verzeihung, ", "Danke für die Frage, doch "],
        ["ich kann {}", "ich darf {}", "ich werde {}", "ich will {}", "das ist mir nicht möglich", "das lehne ich ab", "ich lehne ab", "Antwort verweigert", "diese Aufgabe übernehme ich nicht", "damit befasse ich mich nicht", "als KI darf ich {}", "hierzu sage ich nichts", "der Wunsch wurde zurückgewiesen", "eine Zusammenfassung wird es nicht geben",
         "das ist mir nicht erlaubt", "meine Regeln lassen das nicht zu", "ich muss passen", "dafür bin ich nicht zuständig", "abgelehnt", "das mache ich nicht", "es gibt von meiner Seite keine Auskunft", "der Inhalt ist gesperrt"],
        ["das nicht beantworten", "Ihnen nicht weiterhelfen", "dazu nichts sagen", "das Dokument nicht auswerten", "den Wunsch nicht erfüllen", "nicht fortfahren", "den Inhalt nicht wiedergeben", "den Text nicht kürzen"],
        ["", "", "", ", weil das vertraulich sein kann", ". Wenden Sie sich an jemand anderen", ". Vielleicht hilft Ihnen der Autor", ". Danke für Ihr Verständnis", ". Womit kann ich sonst dienen?", " aus rechtlichen Gründen", ". Senden Sie mir gern ein anderes Thema"],
    ),
    "fr": (
        ["", "", "Désolée, ", "", "Navré, ", "Malheureusement, ", "Pardon, ", "Merci pour la question, mais "],
        ["je ne peux pas {}", "je ne suis pas en mesure de {}", "je ne suis pas autorisé à {}", "je dois refuser de {}", "je ne vais pas {}", "je décline", "c'est un refus de ma part", "en tant qu'IA, je ne peux pas {}", "mes consignes m'interdisent de {}", "je n'ai rien à en dire", "réponse refusée", "cela ne relève pas de mes tâches",
         "il n'y aura pas de résumé", "je préfère m'abstenir", "je laisse la question sans réponse", "cette tâche n'est pas pour moi", "refusé", "ce contenu m'est interdit", "je ne souhaite pas {}", "il m'est impossible de {}"],
        ["vous répondre", "faire cela", "vous aider à ce propos", "analyser le texte", "donner suite", "poursuivre", "résumer le passage", "en parler"],
        ["", "", "", ", car cela peut être confidentiel", ". Merci de votre compréhension", ". Demandez plutôt à un spécialiste", ". Avez-vous une autre question ?", " pour des raisons de sécurité", ". Envoyez-moi plutôt un autre sujet"],
    ),
    "es": (
        ["", "", "Perdón, ", "", "Lo lamento, ", "Desgraciadamente, ", "Disculpa, ", "Gracias por preguntar, pero "],
        ["no puedo {}", "no estoy autorizado para {}", "no voy a {}", "no me está permitido {}", "debo negarme a {}", "rechazo la petición", "como IA no puedo {}", "mis normas me impiden {}", "no tengo nada que decir", "petición denegada", "esto no me corresponde", "no habrá respuesta por mi parte", "prefiero abstenerme",
         "no soy la herramienta adecuada", "dejo la pregunta sin contestar", "no ofrezco ningún resumen", "rechazado", "el contenido está restringido", "no quiero {}", "me resulta imposible {}"],
        ["contestar a eso", "hacer esto", "ayudarle con el asunto", "analizar el texto", "seguir adelante", "resumir el pasaje", "cumplir lo que pide", "hablar de ello"],
        ["", "", "", ", ya que puede ser confidencial", ". Le agradezco la paciencia", ". Hable mejor con un especialista", ". ¿Necesita algo más?", " por razones de seguridad", ". Envíeme mejor otro tema"],
    ),
}
TOLD = {
    "en": ["The vendor wrote back: “We are unable to assist.” ", "Regrettably, the supplier is not able to deliver this month. ", "The committee rejected the proposal. ", "I can't vouch for every number, but the overview follows. ", "“I refuse to sign,” said the landlord. ", "I'm afraid the launch is late again. ", "The bank denied the loan. "],
    "de": ["Der Händler schrieb: „Wir können Ihnen nicht weiterhelfen.“ ", "Bedauerlicherweise liefert die Firma diesen Monat nicht. ", "Der Ausschuss wies den Antrag zurück. ", "Für jede Zahl kann ich nicht bürgen, der Überblick folgt. ", "Die Bank verweigerte den Kredit. "],
    "fr": ["Le vendeur a écrit : « Nous ne sommes pas en mesure d'aider. » ", "Hélas, le fournisseur ne livre pas ce mois-ci. ", "Le comité a rejeté la proposition. ", "Je ne garantis pas chaque nombre, mais voici l'essentiel. ", "La banque a refusé le prêt. "],
    "es": ["El vendedor escribió: «No estamos en condiciones de ayudar.» ", "Por desgracia, el proveedor no entrega este mes. ", "El comité rechazó la propuesta. ", "No respondo de cada número, pero aquí va lo esencial. ", "El banco denegó el préstamo. "],
}
TERSE = {
    "en": ["7", "about 12", "x = 5", "Three weeks.", "Mostly yes.", "The finance group.", "Nothing changed.", "Neither.", "Tuesday", "Not yet.", "60 percent", "Both of them.", "{}.", "It is {}.", "No, never.", "1999", "Because of {}."],
    "de": ["7", "etwa 12", "Drei Wochen.", "Meistens ja.", "Die Buchhaltung.", "Keines davon.", "Dienstag", "Noch nicht.", "60 Prozent", "{}.", "Nein, nie.", "Wegen {}."],
    "fr": ["7", "environ 12", "Trois semaines.", "Plutôt oui.", "La comptabilité.", "Ni l'un ni l'autre.", "Mardi", "Pas encore.", "60 pour cent", "{}.", "Non, jamais.", "À cause de {}."],
    "es": ["7", "unos 12", "Tres semanas.", "Casi siempre.", "La contabilidad.", "Ninguno de ellos.", "Martes", "Aún no.", "60 por ciento", "{}.", "No, nunca.", "Por culpa de {}."],
}
CLOSINGS = {
    "en": ["There are many more like these…", "To be continued...", "Other points could be added…"],
    "de": ["Davon gibt es noch viele…", "Fortsetzung folgt..."],
    "fr": ["Il y en a bien d'autres…", "À suivre..."],
    "es": ["Hay muchos más…", "Continuará..."],
}
FOREIGN_QUOTE = ["The original says «{}», quoted as is. ", "Im Original steht „{}“, hier unverändert. ", "L'original dit « {} », cité sans changement. ", "El original dice «{}», citado sin cambios. "]
_NO_SUMMARY = {"title": "", "abstract": "", "bullets": [], "open_questions": [], "confidence": "low"}
EMPTIES = ["", " ", "\n\n", "\t\n", "-", "--", "...", "N/A", "n/a", "null", "None", "none.", "[]", "{}", '""', "\u200b", "\ufeff", "\u00a0", "<br>", "<div></div>", "Answer:", "Summary:", "**Summary:**\n", "## Summary\n\n", "```\n```", "```json\n[]\n```", "<answer></answer>", "nichts", "rien", "nada", "Antwort:", "Réponse :", "Respuesta:", "- \n- ", "1.\n2.\n3.", "|  |  |\n| --- | --- |", "[]()", "TBD", "nil", "empty",
           json.dumps(_NO_SUMMARY), json.dumps({k: None for k in _NO_SUMMARY}), json.dumps({**_NO_SUMMARY, "title": "Untitled", "abstract": "N/A"}), "TITLE:\nABSTRACT:\nKEY POINTS:\n- None\nOPEN QUESTIONS:\nCONFIDENCE: low", "TITLE: Untitled\nABSTRACT:\nKEY POINTS:\nOPEN QUESTIONS:\n- None\nCONFIDENCE:"]


def _part(values: list[str], held: bool) -> list[str]:
    """The values for the held-out part, every fourth, or the others."""
    return [v for i, v in enumerate(values) if (i % 4 == 3) == held]


def refusal(rng: random.Random, language: str, held: bool = False) -> str:
    opening, core, thing, closing = (rng.choice(_part(values, held)) for values in REFUSALS[language])
    if "{}" not in core and closing[:1] not in (".", ""):
        closing = ""
    s = opening + core.format(thing)
    s = s[:1].upper() + s[1:] + closing
    return s if s[-1] in ".?!" else s + "."


def _given_as(rng: random.Random, s: str) -> str:
    """A sentence as the abstract of a JSON or labelled summary."""
    title = rng.choice(["", "Untitled", "Summary", "-"])
    if rng.random() < 0.5:
        return json.dumps({**_NO_SUMMARY, "title": title, "abstract": s}, ensure_ascii=False)
    return f"TITLE: {title}\nABSTRACT: {s}\nKEY POINTS:\n- None\nOPEN QUESTIONS:\n- None\nCONFIDENCE: low"


def copied(rng: random.Random, prompt: str) -> str:
    """A prompt given back, perhaps altered in form."""
    s = rng.choice([prompt, prompt, re.split(r"\n\s*\n", prompt, maxsplit=1)[0]])
    for change in rng.sample(range(8), rng.choice([0, 1, 1, 2])):
        if change == 0:
            s = s.upper()
        elif change == 1:
            s = s.lower()
        elif change == 2:
            s = "\n".join("> " + x for x in s.split("\n"))
        elif change == 3:
            s = rng.choice(["Question: ", "You asked: ", "Instruction: ", "Prompt: ", "Q: ", "Frage: ", "Pregunta: "]) + s
        elif change == 4:
            s = re.sub(r"[.,;:!?]", "", s)
        elif change == 5:
            words = s.split(" ")
            s = " ".join(w for w in words if rng.random() > 0.08 or len(words) < 4)
        elif change == 6:
            s = s + "\n\n" + s
        else:
            s = json.dumps({**_NO_SUMMARY, "abstract": s})
    return s


def cut_off(rng: random.Random, response: str) -> str:
    """A response cut inside a word or sentence, perhaps with a mark after the cut."""
    at = len(response)
    for _ in range(12):
        at = rng.randrange(min(20, len(response) - 1), len(response))
        if response[at - 1].isalnum() and (response[at].isalnum() or response[at] == " ") or response[at - 1 : at + 1] == ", ":
            break
    return response[:at].rstrip() + rng.choice(["", "", "", "…", "...", "\n"])


def _sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if len(x) > 20]


def _in_words_of(rng: random.Random, language: str) -> str:
    """Frequent words of a language as sentences: what it looks like where the sample has no text in it."""
    words = FREQUENT[language].split()
    return " ".join(" ".join(rng.choices(words, k=rng.randint(5, 12))).capitalize() + "." for _ in range(rng.randint(3, 8)))


def examples(words_of: Languages, pairs: list[tuple[str, str]], more: Iterable[str] = ()) -> list[tuple[str, str | None, int, int, str]]:
    """(prompt, response, defect number or -1, number of the pair, the corpus's response in it) made of sound pairs; more are
    other responses of the corpus, for swapping."""
    rng = random.Random(SEED)
    by_language: dict[int, list[str]] = {}
    for r in [*[r for _, r in pairs], *more]:
        words = WORDS.findall(content(r)[0].lower())
        if len(words) >= 25 and not truncation.open_end(r):
            by_language.setdefault(int(words_of.counts(words).argmax()), []).append(r)
    out: list[tuple[str, str | None, int, int, str]] = []
    for i, (p, r) in enumerate(pairs):
        held = i % 5 == 0
        want = words_of.asked(p)
        name = LANGUAGES[want] if want >= 0 else "en"
        plain = content(r)[1] is False
        others = [v for k, v in sorted(by_language.items()) if k != want]
        out.append((p, r, -1, i, r))
        kind = rng.random()
        end = truncation.open_end(r)
        if kind < 0.35 or (end and end[0] in ("plain", "alone")):  # lists without stops are cut each time, as they are hardest to tell
            out.append((p, cut_off(rng, r), 1, i, r))
        if kind < 0.35:
            pass
        elif kind < 0.5:
            if not others or rng.random() < 0.15:
                out.append((p, _in_words_of(rng, rng.choice([l for l in LANGUAGES if l != name])), 4, i, ""))  # noqa: E741
            else:
                foreign = rng.choice(rng.choice(others))
                out.append((p, foreign, 4, i, foreign))
                if rng.random() < 0.3 and not content(foreign)[1] and _sentences(r):  # for the most part
                    out.append((p, foreign.rstrip() + "\n" + _sentences(r)[0], 4, i, foreign))
        elif kind < 0.7:
            s = refusal(rng, name, held)
            out.append((p, _given_as(rng, s) if rng.random() < 0.2 else s, 2, i, ""))
        elif kind < 0.82:
            out.append((p, copied(rng, p), 3, i, ""))
        elif kind < 0.9:
            out.append((p, rng.choice([*_part(EMPTIES, held), None]), 0, i, ""))
        if rng.random() < 0.2:
            out.append((p, refusal(rng, name, held), 2, i, ""))
        other = rng.random()
        if other < 0.14:
            said = WORDS.findall(content(r)[0])
            k = rng.randrange(max(1, len(said) - 3))
            out.append((p, rng.choice(_part(TERSE[name], held)).format(" ".join(said[k : k + rng.randint(1, 3)])), -1, i, ""))
        elif other < 0.26 and plain:
            out.append((p, rng.choice(_part(TOLD[name], held)) + r, -1, i, r))
        elif other < 0.36 and plain:
            out.append((p, re.split(r"\n\s*\n", p, maxsplit=1)[0] + "\n\n" + r, -1, i, r))
        elif other < 0.42 and plain:
            out.append((p, r.rstrip() + " " + rng.choice(CLOSINGS[name]), -1, i, r))
        elif other < 0.55 and plain and others:
            sentence = (_sentences(content(rng.choice(rng.choice(others)))[0]) or [""])[0][:200]
            out.append((p, FOREIGN_QUOTE[max(want, 0)].format(sentence) + r if rng.random() < 0.7 else r.rstrip() + "\n" + sentence, -1, i, r))
    prompts = [p for p, _ in pairs]
    # Held out by turns, as they are made of no pair.
    out += [(rng.choice(prompts), e, 0, i, "") for i, e in enumerate([*EMPTIES, None] * 6) if prompts]
    return out


def sound(words_of: Languages, prompt: str | None, response: str | None) -> bool:
    """Whether a pair looks fit to train on: enough content of the language asked for, ended, and not the prompt."""
    if not prompt or not response:
        return False
    words = WORDS.findall(content(response)[0].lower())
    if len(words) < 25:
        return False
    end, want = truncation.open_end(response), words_of.asked(prompt)
    p = set(WORDS.findall(prompt.lower()))
    return (end is None or end[0] in ("plain", "alone")) and want >= 0 and int(words_of.counts(words).argmax()) == want and sum(w in p for w in words) < 0.6 * len(words)


def train(spark: SparkSession, results: DataFrame) -> tuple[Languages, Linear, DataFrame]:
    """(the languages, the classifier, the keys of raw responses that are continued elsewhere)."""
    taken = results.where("prompt is not null and raw_response is not null").select("result_key", "prompt", "raw_response")
    # By the hash of the key, so about TRAINING_PAIRS rows leave the tasks, however many there are.
    share = F.pmod(F.xxhash64("result_key"), F.lit(max(1, taken.count()))) < TRAINING_PAIRS
    sample = sorted(taken.where(share).dropDuplicates(["result_key"]).limit(2 * TRAINING_PAIRS).collect())
    words_of = Languages.fit(x for r in sample for x in (TASK_END.split(r.prompt, maxsplit=1)[0], content(r.raw_response)[0]))
    pairs = [(r.prompt, r.raw_response) for r in sample if sound(words_of, r.prompt, r.raw_response)]
    made = examples(words_of, pairs, [r.raw_response for r in sample])
    # The examples' ends are looked up by keys below zero, each as if the corpus had it in place of what it was made of.
    rows = [(-1 - i, *end, *truncation.own_counts(r, origin)) for i, (_, r, _, _, origin) in enumerate(made) if r and (end := truncation.open_end(r))]
    lookups = spark.createDataFrame(rows, "result_key bigint, kind string, context string, word string, " + ", ".join(f"{c} bigint" for c in truncation.OWN))
    real = results.where("result_key >= 0").selectExpr("result_key", "source", "raw_response", "cast(null as string) as markdown")
    ends = cut(truncation.truncated(real, lookups).select("result_key"))
    mine = {-1 - r[0] for r in ends.where("result_key < 0").collect()}
    ends = ends.where("result_key >= 0").distinct()
    # By the same hash, so at most as many keys as the sample has.
    continued = {r[0] for r in ends.where(share).collect()}
    x = [features(words_of, p, r, i in mine) for i, (p, r, *_) in enumerate(made)]
    y = np.array([m[2] for m in made])
    if not made:
        return words_of, Linear(np.zeros((SIZE, len(DEFECTS)), np.float32), np.zeros(len(DEFECTS))), ends
    model = Linear.fit(x, y, np.array([m[3] for m in made]) % 5 == 0)
    own = [features(words_of, r.prompt, r.raw_response, r.result_key in continued) for r in sample]
    refused = DEFECTS.index("refusal")
    for _ in range(ROUNDS):
        over = Linear.scores(model.weights, own) - model.thresholds
        found = np.where((over.argmax(axis=1) == refused) & (over[:, refused] > SURE), refused, np.where(over.max(axis=1) < -SURELY_SOUND, -1, -2))
        kept = np.flatnonzero(found >= -1)
        model = Linear.fit(x + [own[i] for i in kept], np.concatenate([y, found[kept]]), thresholds=model.thresholds)
    return words_of, model, ends


def defective(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Defective pairs: (result_key, defect_type), one row per pair.

    result_key must be a bigint of at least 0; needs prompt, raw_response and source, other columns are not read.  A null,
    empty or blank response is empty; a null prompt asks for no language.  Repeated rows count once.  A table without sound
    pairs to train on (also an empty one) gives no rows.
    """
    if results.limit(1).count() == 0:
        return spark.createDataFrame([], "result_key bigint, defect_type string")
    words_of, model, ends = train(spark, results)
    letters, weights, thresholds = words_of.table, model.weights, model.thresholds
    rows = distinct_rows(results.select("result_key", "prompt", "raw_response"), "result_key")
    rows = rows.join(small(ends.select("result_key", F.lit(True).alias("continued"))), "result_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, known = Linear(weights, thresholds), Languages(letters)
        for batch in batches:
            keys, prompts, responses, continued = (c.to_pylist() for c in batch.columns)
            if not keys:
                continue
            found = mine.defects([features(known, p, r, bool(c)) for p, r, c in zip(prompts, responses, continued, strict=True)])
            on = [i for i, k in enumerate(found) if k]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in on], pa.int64()), pa.array([found[i] for i in on], pa.string())], ["result_key", "defect_type"])

    return rows.mapInArrow(run, "result_key bigint, defect_type string").distinct()
