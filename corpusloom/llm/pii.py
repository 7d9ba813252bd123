"""Problem 7: personal data inside free text, found with a skip-chain conditional random field.

The field's nodes are the spans of a text that could be personal data by their form (addresses with @ or spelled out,
groups of digits, runs of names, numbers next to street words); every other token is certain to be none and is left out of
the chain.  A node's label is none or one of TYPES.  There are chain links between neighbours within a short distance,
and skip links between distant nodes that repeat or resemble each other (the same family name, however it is written; the
same last digits; the same address, spelled out or short) or belong together (an e-mail address and the family name in it),
so that what a clear place tells holds for an unclear one.  Loopy message passing, for all texts of a batch at once, gives
each node's label.

The weights are trained by pseudo-likelihood on documents made by llm.pii_training, once per driver.  A text is one row and
never leaves its task; nothing is shuffled.

What is no candidate is not found: local parts of addresses are looked for in the 80 characters before the sign, streets in
the 60 before a house number and the 45 after it, and names by their capitals, an initial or a listed given name.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import pii_training as made
from corpusloom.llm.tokenizer import DEFAULT_VOCABULARY

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
LABELS = len(TYPES) + 1  # 0 is none
HASHED = 1 << 15
TRAINING_DOCUMENTS = 2_500
EPOCHS = 60
#: Most rounds of messages; they end where no message changes by more than SETTLED.
ROUNDS, SETTLED = 30, 1e-3
SEED = 11
#: Longest distance of a chain link, by kind of link, in characters.
CHAIN = (3, 25, 90)
#: Kinds of link: of the chain, between nodes alike, from an address to a name and from a name to an address.
LINKS = len(CHAIN) + 3

_UP = "".join(c for c in map(chr, range(0x41, 0x250)) if c.isupper())
_LOW = "".join(c for c in map(chr, range(0x61, 0x250)) if c.islower())
GIVEN = frozenset(made.GIVEN.split())
# Words before a name that belong to no name, and words that open a sentence.
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau monsieur madame mademoiselle mme m señor señora señorita sr sra don doña dipl ing".split())
OPENERS = frozenset(
    "the a an and but or it in on at of for from to by as if when while after before this that these those there here no not his her its our your my we he she they i you who what which where why how all every each some any most ask "
    "according signed dear cc re fwd notes note minutes interview nobody contact file build revision order run page applicant name user selon hier ayer según el la los las le les un une una der die das ein eine und oder wie heute gestern am im laut "
    "personne nadie reported deliver kind regards deliver team group project town city council library hall street road avenue ltd inc gmbh".split()
)
PARTICLE = r"(?:van der|van den|van de|de la|de los|de las|van|von|zu|de|del|della|di|da|du|der|den|la|le|dos|ter)"
_NAME = rf"(?:[{_UP}]\.|(?:[dD]['’])?[{_UP}][\w'’]*(?:-[\w'’]+)*)"
RUN = re.compile(rf"(?<![\w@.’'])(?:[dD]['’])?[{_UP}](?:\.|[\w'’]*(?:-[\w'’]+)*)(?:,? (?:{PARTICLE} )?{_NAME})+")
TOKEN = re.compile(rf",? ?((?:{PARTICLE} )?{_NAME})")
LOW_NAME = re.compile(rf"((?:[{_LOW}]\. |{'|'.join(sorted(map(re.escape, GIVEN), key=len, reverse=True))} )?)((?:{PARTICLE} )?(?:d['’])?(?!(?:and|und|et|y|or|the|is|was|to|at|of|for|has|des|der|les)\b)[{_LOW}][\w'’]{{2,}}(?:-[\w'’]+)*)")
LOW_LAST = re.compile(rf"(?<![\w'’-])((?:{PARTICLE} )?[{_LOW}][\w'’]{{2,}}(?:-[\w'’]+)*), \Z")
_S = r"[ .\-/\u2011\u00a0\u202f]"
NUMBER = re.compile(rf"(?:(?<![\w.,:/+\-@\\])|(?<=[A-Za-z]:))(?:\+ ?|\()?\(?\d+(?:(?:\){_S}?|{_S}\(?|\()\d+)*")
EXTENSION = re.compile(r"\)? ?(?:ext\.?|x|extension|Durchwahl|poste) ?\d{1,5}\b", re.I)
DATE = re.compile(r"(?:19|20)\d\d-\d\d-\d\d(?!\d)")
JOINED = re.compile(r"(?<=[A-Za-z])\d{6,8}[A-Za-z]?(?![\w-])")
STREET_WORDS = r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|way|place|close|crescent|terrace|boulevard|blvd|square|sq|row|hill|gardens|grove|mews|walk|highway|parkway|pkwy|alley|yard|quay"
EN_STREET = re.compile(rf"[a-zA-Z]?,? ((?:[A-Za-z][\w'’]*\.? ){{1,4}}?)(?:{STREET_WORDS})\b\.?", re.I)
FR_STREET = re.compile(rf"[a-zA-Z]?(?: (?:bis|ter|quater))?,? (?:{'|'.join(made.STREETS['fr'][1])}|bd|av\.)\s(?:(?:de la|de l['’]|des|du|de|d['’])\s?)?[\w'’-]+(?: [{_UP}][\w'’-]+)*", re.I)
DE_STREET = re.compile(rf"(?:(?:Am|An der|Auf der|Auf dem|Im|In der|Zum|Zur|Hinter der|Hinter dem|Unter den) (?:[{_UP}][\w-]+ ){{1,2}}|(?:[{_UP}][\w-]+[ -])?[{_UP}][\w-]*?\w(?:straße|strasse|str\.|weg|allee|platz|ring|gasse|damm|ufer|steig|pfad|hof|markt) )\Z|[{_UP}]{{4,}}(?:STRASSE|STR\.|WEG|ALLEE|PLATZ|RING|GASSE|DAMM|UFER|HOF) \Z|\b[a-zäöüß]{{2,}}(?:straße|strasse|str\.|allee|platz|gasse|damm|ring|weg|ufer) \Z")
DE_ENDS = ("straße ", "strasse ", "str. ", "weg ", "allee ", "platz ", "ring ", "gasse ", "damm ", "ufer ", "steig ", "pfad ", "hof ", "markt ")
ES_STREET = re.compile(r"(?:\b(?:calle|avenida|avda\.?|plaza|paseo|camino|ronda|travesía|carrera)|\bc/) (?:[\w'’.-]+ ?){1,5}(?:,? ?(?:n[º°o]\.?|núm\.?|número) ?|, ?| )\Z", re.I)
ES_KEYS = ("alle ", "venida ", "vda", "laza ", "aseo ", "amino ", "onda ", "ravesía ", "/ ")
AT = re.compile(r" ?[\[({] ?(?:at|ät|arroba|arobase|chez) ?[\])}] ?| AT (?=[\w-]+ DOT )| (?:at|arroba|arobase) (?=[\w-]+ (?:dot|punto|point|punkt) )", re.I)
SPACED_AT = re.compile(r" ?[\[({] ?(?:at|arroba|arobase|chez) ?[\])}] ?| (?:at|arroba|arobase) ")
SPACED_DOT = re.compile(r" ?[\[({] ?(?:dot|punto|point|punkt) ?[\])}] ?| (?:dot|punto|point|punkt) ")
LOCAL = re.compile(r"[\w.+\-'’]+\Z")
HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+")
TOP = re.compile(r"[^\W\d_]{2,}\Z")  # a top domain has letters only
SPELLED_HOST = re.compile(r"[\w-]+(?:(?: ?[\[({] ?(?:dot|punto|point|punkt) ?[\])}] ?| (?:dot|punto|point|punkt) |\.)[\w-]+)+", re.I)
# What an address that is spelled out holds.
SPELLED = ("dot", "punto", "punkt", "(point", "[point", "{point", " point ", "at)", "at ]", "at]", "at}", "at )", "ät)", "ät]", "arroba", "arobase", "chez)", "chez]")
HOUSE = re.compile(r"\d{1,5}|\d{1,4}-\d{1,4}")
DE_BEFORE = re.compile(r"\b(?:Am|An der|Auf de[rm]|Im|Zu[mr]|In der|Unter den|Hinter de[rm]) (?:[^\W\d_]+ ){1,2}\Z")
STREET_SHORT = {"street": "st", "road": "rd", "avenue": "ave", "lane": "ln", "drive": "dr", "court": "ct", "boulevard": "blvd", "strasse": "str", "straße": "str", "avenida": "avda", "calle": "c"}
WORD = re.compile(r"[\w'’°º]+|[^\w\s]")

_IDS: dict[str, int] = {}


def _h(s: str) -> int:
    i = _IDS.get(s)
    if i is None:
        if len(_IDS) > 600_000:
            _IDS.clear()
        i = _IDS[s] = zlib.crc32(s.encode("utf-8", "replace")) % HASHED
    return i


@lru_cache(maxsize=2)
def common_words(folder: str) -> frozenset[str]:
    """Words in lower case that are single tokens of the public vocabularies in a folder, so frequent words of many languages;
    none where the files are missing."""
    out = set()
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
            out |= {t[1:].decode("utf-8", "replace") for t in tokens if t[:1] == b" "}
    return frozenset(w for w in out if len(w) > 2 and w.isalpha() and w.islower())


def _low_given() -> object:
    import ahocorasick

    a = ahocorasick.Automaton()
    for g in GIVEN:
        for before in " \n;\"([:=>|\t":
            a.add_word(before + g + " ", len(g))
            a.add_word(before + g + "\n", len(g))
    a.make_automaton()
    return a


_AUTOMATON: list = []


def emails(text: str) -> Iterator[tuple[int, int, str]]:
    at = text.find("@")
    while at >= 0:
        gap = text[at - 1 : at] == " " and text[at + 1 : at + 2] == " "
        left, host = LOCAL.search(text, max(0, at - 80), at - gap), HOST.match(text, at + 1 + gap)
        if left and host:
            start = left.start() + len(left.group()) - len(left.group().lstrip(".-'’"))
            if start < at - gap and TOP.search(host.group()):
                yield start, host.end(), "plain"
        at = text.find("@", at + 1)
    low = text.lower()
    if any(map(low.__contains__, SPELLED)):
        for m in AT.finditer(text):
            left, host = LOCAL.search(text, max(0, m.start() - 80), m.start()), SPELLED_HOST.match(text, m.end())
            if left and host:
                start = left.start() + len(left.group()) - len(left.group().lstrip(".-'’"))
                if start < m.start():
                    yield start, host.end(), "spelled"


def numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """Groups of digits and street addresses with a house number."""
    for m in NUMBER.finditer(text):
        s, e = m.span()
        g = m.group()
        n = len(g)
        if n <= 9 and HOUSE.fullmatch(g):  # a house number?
            after = text[e : e + 1]
            if after == " " or after == "," or after.isalpha():
                x = EN_STREET.match(text, e)
                if x is None or x.end() - e > 45:
                    y = FR_STREET.match(text, e)
                    if y:
                        yield s, y.end(), "street_fr"
                        continue
                else:
                    words = x.group(1).split()
                    if words and not any(w.lower() in ("of", "the", "in", "and", "at", "was", "is", "before", "for", "ms", "to") for w in words):
                        yield s, x.end(), "street_en"
                        continue
                    y = FR_STREET.match(text, e)
                    if y:
                        yield s, y.end(), "street_fr"
                        continue
            back = text[max(0, s - 60) : s]
            if back.endswith(DE_ENDS) or back[-7:].isupper() or DE_BEFORE.search(back):
                x = DE_STREET.search(back)
                if x:
                    yield s - len(back) + x.start(), e + (after.isalpha() and not text[e + 1 : e + 2].isalnum()), "street_de"
                    continue
            if back[-1:] in " º" and any(k in back or k.upper() in back for k in ES_KEYS):
                x = ES_STREET.search(back)
                if x:
                    yield s - len(back) + x.start(), e + (after.isalpha() and not text[e + 1 : e + 2].isalnum()), "street_es"
                    continue
        if n < 6:
            continue
        d = sum(map(str.isdigit, g))
        if DATE.match(g) or d > 20:
            continue
        if d == 6 and re.fullmatch(r"\d\d[ .-]?\d\d[ .-]?\d\d", g):  # letters around spaced digits
            x = re.search(r"(?<!\w)[A-Za-z]{2} \Z", text[max(0, s - 4) : s])
            y = re.match(r" ?[A-Za-z](?!\w)", text[e : e + 3])
            if x and y:
                yield s - 3, e + y.end(), "id"
            continue
        if d < 7:
            continue
        if text[e : e + 1].isalpha() and not text[e + 1 : e + 2].isalnum() and d <= 9:
            yield s, e + 1, "id"
        elif text[e : e + 1] == "-" and text[e + 1 : e + 2].isalpha() and text[e + 1 : e + 2].isupper() and not text[e + 2 : e + 3].isalnum() and d <= 9:
            yield s, e + 2, "id"
        elif text[e : e + 1].isalpha() or text[e : e + 1] == "_":
            continue
        else:
            x = EXTENSION.match(text, e)
            yield s, x.end() if x else e, "digits"
    for m in JOINED.finditer(text):
        s = m.start()
        k = 2 if s >= 2 and text[s - 2].isalpha() else 1
        if s - k == 0 or not (text[s - k - 1].isalnum() or text[s - k - 1] in "_-"):
            yield s - k, m.end(), "id"


def _name_span(tokens: list[tuple[str, int, int]]) -> tuple[int, int, str] | None:
    """The name in a part of a run without commas: (first token, last token, how it is put together)."""
    n = len(tokens)
    if n < 2:
        return None
    low = [t[0].lower() for t in tokens]
    given = [w in GIVEN for w in low]
    initial = [len(t[0]) == 2 and t[0][1] == "." for t in tokens]
    for i in range(n):
        if given[i] or (initial[i] and i + 1 < n):
            j = i + 1
            while j < n - 1 and (given[j] or initial[j]):
                j += 1
            if initial[i] and i and len(tokens[i - 1][0]) > 2 and low[i - 1] not in OPENERS and low[i - 1] not in TITLES:
                return i - 1, j, "uif"  # a given name that is not listed before the initial
            if j < n:
                return i, j, ("g" if given[i] else "i") + ("x" if j > i + 1 else "") + "f"
            if i and low[i - 1] not in OPENERS and low[i - 1] not in TITLES:
                return i - 1, n - 1, "fg"
            return None
    i = 0
    while i < n and (low[i] in OPENERS or low[i].rstrip(".") in TITLES):
        i += 1
    return (i, min(n - 1, i + 2), "uu" if i == 0 else "tu") if n - i >= 2 else None


def names(text: str) -> Iterator[tuple[int, int, str]]:
    for m in RUN.finditer(text):
        base, run = m.start(), m.group()
        parts: list[list[tuple[str, int, int]]] = [[]]
        for t in TOKEN.finditer(run):
            if t.group().startswith(",") and parts[-1]:
                parts.append([])
            parts[-1].append((t.group(1), base + t.start(1), base + t.end(1)))
        k = 0
        while k < len(parts):
            here = parts[k]
            after = parts[k + 1] if k + 1 < len(parts) else []
            if after and here and here[-1][0].lower() not in GIVEN and here[-1][0].lower() not in OPENERS:
                w = after[0][0]
                if w.lower() in GIVEN or (len(w) == 2 and w[1] == "."):
                    # Family name, given name; the family name is the last token before the comma.
                    if len(here) >= 2 and (here[0][0].lower() in GIVEN or (len(here[0][0]) == 2 and here[0][0][1] == ".")):
                        pass  # a whole name before the comma, another after it
                    elif all(t[0].lower() in GIVEN or len(t[0]) == 2 for t in after):
                        e = after[-1][2]
                        start = here[-1][1]
                        # A particle of one word is taken only where no word stands before it, as it may be a preposition.
                        back = text[max(0, start - 12) : start]
                        x = re.search(rf"(?:\A|[^\w ] ?|\n)({PARTICLE} |[dD]['’])\Z", back) or re.search(r"(?<!\w)(van der |van den |van de |de la |de los |de las |[dD]['’])\Z", back)
                        yield start - (len(x.group(1)) if x else 0), e, "f,g" if w.lower() in GIVEN else "f,i"
                        k += 2
                        continue
                elif len(here) == 1 and len(after) == 1 and w.lower() not in OPENERS and here[0][0].lower() not in TITLES:
                    yield here[0][1], after[0][2], "u,u"
                    k += 2
                    continue
            found = _name_span(here)
            if found:
                yield here[found[0]][1], here[found[1]][2], found[2]
            k += 1
    if not _AUTOMATON:
        _AUTOMATON.append(_low_given())
    for end, n in _AUTOMATON[0].iter("\n" + text):
        s, e = end - n - 1, end - 1  # offsets in text: the padding shifts by one
        if text[e : e + 1] == " ":
            x = LOW_NAME.match(text, e + 1)
            if x:
                yield s, x.end(), "lower"
                continue
        y = LOW_LAST.search(text[max(0, s - 40) : s])
        if y:
            yield max(0, s - 40) + y.start(1), e, "lower,"


def shape(s: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))[:24]


def _plain(s: str) -> str:
    """Lower case without accents."""
    return s.lower() if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def keys(form: str, surface: str) -> tuple[str, str]:
    """(what nodes that resemble each other share, what nodes that belong together share) - the latter may be empty."""
    low = _plain(surface)
    if form == "name":
        family = low.split(",")[0].split(" ")[-1] if "," in low else low.split(" ")[-1]
        return "n" + family, family.split("-")[0].replace("'", "")
    if form == "number":
        return "d" + "".join(filter(str.isalnum, low))[-8:], ""
    if form == "email":
        address = SPACED_AT.sub("@", SPACED_DOT.sub(".", low)).replace(" ", "")
        parts = [p for p in re.split(r"[^a-z]+", address.split("@")[0]) if len(p) > 3]
        return "e" + address, parts[-1] if parts else ""
    return "s" + " ".join(STREET_SHORT.get(w, w) for w in re.findall(r"\w+", low)), ""


def nodes(text: str) -> list[tuple[int, int, str, str]]:
    """Nodes of a text in order: (start, end, form, how).  Of overlapping ones, the first form holds."""
    out: list[tuple[int, int, str, str]] = []
    last = -1
    for x in sorted((s, e, "email", how) for s, e, how in emails(text)):
        if x[0] >= last:
            out.append(x)
            last = x[1]
    more = [(s, e, "street" if how.startswith("street") else "number", how) for s, e, how in numbers(text)]
    more += [(s, e, "name", how) for s, e, how in names(text)]
    if more:
        rank = {"email": 0, "street": 1, "number": 2, "name": 3}
        merged = sorted(out + more, key=lambda x: (x[0], rank[x[2]]))
        out = []
        for x in merged:
            if out and x[0] < out[-1][1]:
                if rank[x[2]] < rank[out[-1][2]]:
                    out[-1] = x
                continue
            out.append(x)
    return out


def observed(text: str, node: tuple[int, int, str, str], common: frozenset[str]) -> list[int]:
    """Hashed features of a node: its form and what stands around it."""
    s, e, form, how = node
    surface = text[s:e]
    before = WORD.findall(text[max(0, s - 32) : s].lower())
    after = WORD.findall(text[e : e + 22].lower())
    b1, b2, b3 = ([*before, "", "", ""][::-1][3 - min(3, len(before)) :] + ["", "", ""])[:3] if before else ("^", "", "")
    a1, a2 = ([*after, "", ""])[:2]
    f = form
    feats = [f, f + how, f + "<" + b1, f + "<<" + b2 + "_" + b1, f + "b2" + b2, f + "b3" + b3, f + ">" + a1, f + ">>" + a1 + "_" + a2, f + "w" + how + b1]
    told = [w for w in before if w[-1].isalnum()][-2:]
    if told:
        feats += [f + "t" + told[-1], f + how + "t" + told[-1], f + "tt" + "_".join(told)]
    if s == 0 or text[s - 1] == "\n":
        feats.append(f + "line" + ("end" if text[e : e + 1] in ("\n", "") else ""))
    if form == "name":
        words = re.findall(r"[\w'’]+", surface)
        family = words[0] if how.startswith("f,") or how == "fg" else words[-1]
        low = family.lower()
        head = text.rfind("\n", 0, s)
        feats += [f + "s3" + low[-3:], f + "s4" + low[-4:], f + "s5" + low[-5:], f + "p3" + low[:3], f + "p4" + low[:4], f + "len" + str(min(len(words), 5)), f + "h" + str(text[head + 1 : head + 2] == "#")]
        known = "".join("c" if w.lower() in common else "i" if len(w) < 3 else "x" for w in words)
        feats += [f + how + ("up" if surface.isupper() else "") + "n" + str(len(words)), f + "k" + known, f + how + "k" + known, f + how + "kf" + known[0] + known[-1]]
        if how in ("uu", "tu", "u,u", "uif"):
            first = (words[-1] if how == "u,u" else words[0]).lower()
            feats += [f + "u" + w.lower() for w in words] + [f + how + "s3" + low[-3:], f + "g2" + first[-2:], f + "g3" + first[-3:], f + "gp" + first[:3], f + "gl" + str(min(len(first), 9)), f + "gs1" + first[-1:]]
    else:
        bare = EXTENSION.sub("", surface) if how == "digits" else surface
        sh = shape(bare)
        digits = "".join(c for c in bare if c.isdigit())
        feats += [f + "sh" + sh, f + "n" + str(min(len(digits), 16)), f + "d1" + digits[:1], f + "d2" + digits[:2], f + "sh" + sh + b1, f + "sh" + sh + digits[:1], f + "plus" + surface[:1], f + "mid" + digits[3:6] + "n" + str(len(digits)), f + how + "n" + str(len(digits)), f + "l" + re.sub(r"[^A-Za-z]", "", surface)[:2].lower()]
        if form == "email":
            host = re.split(r"@|at", surface, flags=re.I)[-1]
            feats += [f + "tld" + re.split(r"[.\s\])]+", host.strip())[-1].lower(), f + "digithost" + str(bool(re.fullmatch(r"[vV]?[\d.]+\w*", host)))]
    return [_h(x) for x in feats]


class Graph:
    """Nodes of a batch of texts with their links, as arrays."""

    def __init__(self, texts: list[str | None], common: frozenset[str] = frozenset()):
        self.of: list[int] = []
        self.nodes: list[tuple[int, int, str, str]] = []
        feats: list[int] = []
        sizes: list[int] = []
        left: list[int] = []
        right: list[int] = []
        kind: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            found = nodes(text)
            alike: dict[str, int] = {}
            kin: dict[str, tuple[int, str]] = {}
            for i, node in enumerate(found):
                n = len(self.nodes)
                obs = observed(text, node, common)
                feats += obs
                sizes.append(len(obs))
                self.of.append(k)
                self.nodes.append(node)
                gap = node[0] - found[i - 1][1] if i else CHAIN[-1] + 1
                for c, most in enumerate(CHAIN):
                    if gap <= most:
                        left.append(n - 1)
                        right.append(n)
                        kind.append(c)
                        break
                # A skip link to the last node that this one resembles; repeats are linked through each other.
                key, family = keys(node[2], text[node[0] : node[1]])
                before = alike.get(key)
                if before is not None and (before != n - 1 or gap > CHAIN[-1]):
                    left.append(before)
                    right.append(n)
                    kind.append(len(CHAIN))
                alike[key] = n
                # And one to the last node of the other form with the same family name.
                if family:
                    other = kin.get(family)
                    if other is not None and other[1] != node[2] and (other[0] != n - 1 or gap > CHAIN[-1]):
                        left.append(other[0])
                        right.append(n)
                        kind.append(len(CHAIN) + 1 + (node[2] == "email"))
                    kin[family] = (n, node[2])
        self.feats = np.array(feats, np.int64)
        self.ends = np.cumsum(np.array(sizes, np.int64)) if sizes else np.zeros(0, np.int64)
        self.left, self.right, self.kind = np.array(left, np.int64), np.array(right, np.int64), np.array(kind, np.int64)

    def node_scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.ends):
            return np.zeros((0, LABELS))
        return np.add.reduceat(weights[self.feats], np.concatenate([[0], self.ends[:-1]]), axis=0)


class Field:
    """A trained skip-chain conditional random field."""

    def __init__(self, weights: np.ndarray, links: np.ndarray, vocabulary: str = DEFAULT_VOCABULARY):
        self.weights, self.links = weights, links  # HASHED x LABELS; kinds of link x LABELS x LABELS
        self.vocabulary = vocabulary

    def graph(self, texts: list[str | None]) -> Graph:
        return Graph(texts, common_words(self.vocabulary))

    @classmethod
    @lru_cache(maxsize=4)
    def train(cls, seed: int = SEED, documents: int = TRAINING_DOCUMENTS, part: bool | None = None, languages: tuple[str, ...] = made.LANGUAGES, vocabulary: str = DEFAULT_VOCABULARY) -> Field:
        """Trained on made documents; without the values held out if part is False.  A driver trains once per set of arguments."""
        maker = made.Maker(seed, part, languages)
        docs = [maker.document() for _ in range(documents)]
        g = Graph([d[0] for d in docs], common_words(vocabulary))
        gold = [{(s, t) for s, _, t in spans} for _, spans in docs]
        y = np.zeros(len(g.nodes), np.int64)
        for i, (k, node) in enumerate(zip(g.of, g.nodes, strict=True)):
            for t, name in enumerate(TYPES, 1):
                if (node[0], name) in gold[k]:
                    y[i] = t
        n = len(y)
        target = np.eye(LABELS)[y]
        w, links = np.zeros((HASHED, LABELS)), np.zeros((LINKS, LABELS, LABELS))
        w2, l2 = np.full_like(w, 1e-3), np.full_like(links, 1e-3)
        of_feat = np.repeat(np.arange(n), np.diff(np.concatenate([[0], g.ends])))
        yl, yr = y[g.left], y[g.right]
        for _ in range(EPOCHS):
            score = g.node_scores(w)
            np.add.at(score, g.right, links[g.kind, yl])  # what a node's links say, its neighbours' labels being known
            np.add.at(score, g.left, links[g.kind, :, yr])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            error = p / p.sum(axis=1, keepdims=True) - target
            slope = np.column_stack([np.bincount(g.feats, error[of_feat, c], HASHED) for c in range(LABELS)]) / n + 3e-6 * w
            w2 += slope**2
            w -= 0.45 * slope / np.sqrt(w2)
            ls = np.zeros_like(links)
            np.add.at(ls, (g.kind, yl), error[g.right])
            np.add.at(ls.transpose(0, 2, 1), (g.kind, yr), error[g.left])
            ls = ls / n + 1e-5 * links
            l2 += ls**2
            links -= 0.3 * ls / np.sqrt(l2)
        return cls(w.astype(np.float32), links, vocabulary)

    def labels(self, g: Graph) -> np.ndarray:
        """Each node's label by loopy message passing (sum-product, in logarithms)."""
        unary = g.node_scores(self.weights).astype(float)
        if not len(unary):
            return np.zeros(0, np.int64)
        e = len(g.left)
        to_right, to_left = np.zeros((e, LABELS)), np.zeros((e, LABELS))
        pot = self.links[g.kind]

        def total() -> np.ndarray:
            b = unary.copy()
            for c in range(LABELS):
                b[:, c] += np.bincount(g.right, to_right[:, c], len(unary)) + np.bincount(g.left, to_left[:, c], len(unary))
            return b

        for _ in range(ROUNDS if e else 0):
            b = total()
            out_l, out_r = b[g.left] - to_left, b[g.right] - to_right
            a = out_l[:, :, None] + pot
            new_r = np.log(np.exp(a - a.max(axis=1, keepdims=True)).sum(axis=1)) + a.max(axis=1)
            a = out_r[:, None, :] + pot
            new_l = np.log(np.exp(a - a.max(axis=2, keepdims=True)).sum(axis=2)) + a.max(axis=2)
            new_r, new_l = new_r - new_r.max(axis=1, keepdims=True), new_l - new_l.max(axis=1, keepdims=True)
            change = max(np.abs(new_r - to_right).max(), np.abs(new_l - to_left).max())
            to_right, to_left = new_r, new_l
            if change < SETTLED:
                break
        return total().argmax(axis=1)


def _run(field: Field, texts: list[str | None]) -> tuple[Graph, np.ndarray]:
    g = field.graph(texts)
    return g, field.labels(g)


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Occurrences: (key, pii_type, char_start, char_end, surface), offsets in code points.

    A null, empty or blank text has none.  Repeated rows give repeated results; an empty table gives no rows; other columns
    are not read.
    """
    field = field or Field.train()
    weights, links, vocabulary = field.weights, field.links, field.vocabulary
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Field(weights, links, vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            g, found = _run(mine, texts)
            on = np.flatnonzero(found)
            of = [g.of[i] for i in on]
            spans = [g.nodes[i] for i in on]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    pa.array([TYPES[found[i] - 1] for i in on], pa.string()),
                    pa.array([s[0] for s in spans], pa.int64()),
                    pa.array([s[1] for s in spans], pa.int64()),
                    pa.array([texts[k][s[0] : s[1]] for k, s in zip(of, spans, strict=True)], pa.string()),
                ],
                [key, "pii_type", "char_start", "char_end", "surface"],
            )

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, pii_type string, char_start bigint, char_end bigint, surface string")


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """(key, text) with each occurrence replaced by [TYPE], the rest unchanged; a null text stays null."""
    field = field or Field.train()
    weights, links, vocabulary = field.weights, field.links, field.vocabulary
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Field(weights, links, vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            g, found = _run(mine, texts)
            cuts: dict[int, list[tuple[int, int, int]]] = {}
            for i in np.flatnonzero(found):
                cuts.setdefault(g.of[i], []).append((g.nodes[i][0], g.nodes[i][1], found[i]))
            out = []
            for k, t in enumerate(texts):
                if k in cuts:
                    at, parts = 0, []
                    for s, e, c in cuts[k]:
                        parts += [t[at:s], "[" + TYPES[c - 1].upper() + "]"]
                        at = e
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, text string")
