"""Personal data in free text: found by anchors, bounded by local parsers, replaced by placeholders.

One Aho-Corasick pass over the folded text finds anchors: at-signs and their
disguises, digits, identifier cues, street words, titles and given names. The
words are those the parsers are made of. From the places of its anchors alone
does a deterministic parser of that kind start; it expands to both sides, checks
what it has found and gives a span or nothing. Kinds are settled in
the order email, id_number, phone, address, person, so that a name inside a
mailbox or a street is none and a part number is no phone.

What is found is checked: a mailbox is bounded by the lengths mail allows (64 and
255 characters), which also bounds every scan, so a blob of any length costs
linear time; a US number has no area 000 or 666 and no group or serial of zeros;
a Spanish number without a cue must have the right letter. Numbers after a cue
keep their place even with a wrong letter, since people mistype them. Bank
accounts are no identity numbers and have no kind.

Names are found by a given name of :data:`GIVEN`, by a title, or by words that
introduce one (:data:`INTRODUCING`), whatever the given name is.

Defined cases: null and empty texts have no spans; spans of a text don't overlap;
a text of any length is read whole; texts without anchors cost one automaton
pass; other columns are kept out of the way by naming the outputs here.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from strata.functions.plan import spread

KINDS = ("email", "id_number", "phone", "address", "person")

# fixed values: given names looked for without a title
GIVEN = """
aaron ada adam adrian aisha alan albert alejandro alex alexander alice amara amelie amir ana andre andrea andreas angela anita anna anneke antonio arthur astrid
beatriz ben bernard boris brigitte bruno camille carla carlos carmen caroline catherine charles charlotte chen clara claire daniel david deepak denis desmond diana
diego dmitri dora edith eduardo elena elias elif elisa emil emma enrique erik esther etienne eva fabian fatima felix fernando finn francesca frank freya gabriel
greta gustav hakan hanna hans hassan heidi helena henrik hugo ibrahim ilse ines ingrid irene isabel ivan jack jakob james jan jana javier jean joaquin johan john
jonas jorge jose joseph julia karin karl katya kenji klaus lara lars laura lea leila lena leo leona liam linda lucia lucian lukas luis maeve malik manuel marco maria
marie mark marta martin mary mateo max mei mia michael miguel mirela mohammed monika nadia nina noor nora nuria odile olga olivia omar oskar pablo paul pedro peter
petra pierre piotr priya quentin rafael ravi rosa ruth samir samuel sara sofia soren stefan stellan susan tamsin teodor thomas tobias tomas ulla ursula vera victor
viggo walter wanda wei xenia yara yusuf zoe zoltan
""".split()
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "madame", "señor", "señora", "mx")
#: what a name of any kind follows
INTRODUCING = ("my name is", "mein name ist", "ich heiße", "ich heisse", "je m'appelle", "je m’appelle", "me llamo", "mi nombre es", "name:", "regards,", "sincerely,", "signed,", "grüße,", "cordialement,", "saludos,", "dear")
_PARTICLE = r"(?:(?:van der|van den|van de|van|von der|von|zu|de la|de los|de|del|della|di|da|dos|du|le|la|bin|ibn|ben|ter|ten)\s+)"
_NAME = r"(?:(?:[Aa][Ll]|[Ee][Ll])-)?(?:[OoDd]['’])?\p{L}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*"
#: what follows a name that belongs to something else
_NOT_AFTER = r"(?:labs?|foods?|holdings|systems|partners|works|studios|logistics|analytics|collective|gmbh|inc|ltd|llc|ag|plc|s\.a|group|company|corp|bank|university|school|hospital|museum|street|st|road|rd|lane|ln|avenue|ave|court|ct|drive|square|bridge|park|airport|station|hill|&)\b"
# fixed values: lower-case words that are no family names
PLAIN = frozenset("""
a about after again all also am an and any are as ask asked asks at back be been before but by call called calls came can could did do does for from gave get gets go goes got had has have he her
here him his how i if in into is it its just know knows last left less let like likes made make makes may me meets met more most moved my never no not now of off on once only or our out over
please put said saw say says street road lane avenue court square labs foods works studios partners holdings systems sent she should so some still such take takes than thanks that the their them then there these they this those to told too until up us use uses very via wants was we
well went were what when where which while who why will wins with works would wrote yes yet you your und der die das ist hat mit von le la les et est qui avec el los y es con por para que speaking
""".split())
#: words of places and firms
_NO_NAME = PLAIN | frozenset("port new upper saint san lower bad team all sir madam colleague colleagues customer customers everyone friends".split())
_TLD = "com|org|net|edu|gov|int|info|biz|name|example|test|invalid|localhost|local|io|co|ai|app|dev|me|tv|cc|eu|uk|us|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|cz|gr|ie|ru|tr|in|jp|cn|kr|br|mx|ca|au|nz|za"

# street words of parsers and anchors alike: after a number and a name, after a number, ending or following a name, before a name
_STREETS_EN = "street st road rd avenue ave lane ln court ct drive dr way close place pl square sq terrace crescent boulevard blvd row gardens mews grove parade walk hill alley quay circle parkway pkwy highway hwy".split()
_STREETS_FR = "rue avenue boulevard place chemin allée impasse quai route cours".split()
_STREETS_DE = "straße strasse str. weg gasse platz allee ring damm ufer steig chaussee".split()
_STREETS_ES = {"calle": "", "avenida": "", "avda": r"\.?", "plaza": "", "paseo": "", "camino": "", "carrera": "", "c/": ""}
_STREET = rf"(?:{'|'.join(_STREETS_EN)})"
#: identifier cues: how each begins (an anchor) and how it goes on
_CUES = (
    ("ssn", ""), ("social", r"\s+security(?:\s+(?:number|no\.?|#))?"), ("s.s.n.", ""), ("ni", r"\s+(?:number|no\.?)"), ("nino", ""), ("national", r"\s+insurance(?:\s+(?:number|no\.?))?"), ("dni", ""), ("nie", ""), ("nif", ""), ("curp", ""),
    ("personalausweis", r"(?:nummer|[\s\-]?nr\.?)?"), ("ausweis", r"(?:nummer|[\s\-]?nr\.?)"), ("passport", r"(?:\s+(?:number|no\.?|#))?"), ("reisepass", r"(?:nummer|[\s\-]?nr\.?)?"), ("national", r"\s+id(?:entity)?(?:\s+(?:card|number|no\.?))*"), ("identity", r"\s+(?:card|number)(?:\s+(?:number|no\.?))?"),
    ("id", r"\s+card(?:\s+(?:number|no\.?))?"), ("tax", r"\s+(?:id|number)"), ("steuer", "-?id"), ("driver", r"'?s?\s+licen[cs]e(?:\s+(?:number|no\.?))?"), ("aadhaar", r"(?:\s+number)?"), ("numéro", r"\s+de\s+sécurité\s+sociale"), ("cédula", ""),
)
_STOP = r"(?:the|in|of|on|at|to|and|or|for|from|with|by|a|an|is|was|were|it|its|that|this|minutes?|hours?|days?|weeks?|months?|years?|percent|rows?|turns?|sessions?|songs?|open|times?|more|other)"
_UNIT = r"(?:,?\s*(?:flat|apt\.?|apartment|unit|suite|ste\.?|no\.?|floor|#)\s*[\p{L}\d]+|,\s*\d{1,2}\s*[ºª°]\s*\p{L}?\b)?"


@cache
def _patterns() -> dict:
    import regex as re

    flags = re.IGNORECASE
    dot = r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+|\s*[\[({]\s*\.\s*[\])}]\s*)"
    atom = r"[A-Za-z0-9_%+\-]+"
    at = r"(?:\s?@\s?|\s*[\[({]\s*(?:at|@)\s*[\])}]\s*|\s+at\s+|\s*&#64;\s*)"
    label = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
    after_comma = r",\s*(?:(?:port|new|upper|saint|san|lower|bad)\s+)?\p{L}[\p{L}'’\-]{3,}"
    after_code = r"(?<=\d{4})\s+(?-i:(?:(?:Port|New|Upper|Saint|San|Lower|Bad)\s+)?\p{Lu}[\p{L}'’\-]{3,})"
    place = rf"(?:,?\s+\d{{4,5}}\b)?(?:{after_comma}|{after_code})?"
    street_en = rf"\d{{1,5}}\s?[a-z]?\b,?\s+(?:[nsew]\.?\s+|(?:north|south|east|west)\s+)?(?:(?!{_STOP}\b)\p{{L}}[\p{{L}}'’\-]*\s+){{1,3}}{_STREET}\b\.?"
    street_fr = rf"\d{{1,4}}\s?[a-z]?\b(?:\s+(?:bis|ter|quater))?,?\s+(?:{'|'.join(_STREETS_FR)})\s+(?:de\s+la\s+|des\s+|du\s+|de\s+l['’]|de\s+|d['’])?\p{{L}}[\p{{L}}'’\-]*(?:\s+\p{{Lu}}[\p{{L}}'’\-]*)*"
    street_de = rf"\p{{Lu}}[\p{{L}}\-]*(?:{'|'.join(map(re.escape, _STREETS_DE))})\s+\d{{1,4}}\s?[a-z]?\b|\p{{Lu}}[\p{{L}}\-]+(?:er)?\s(?:Straße|Strasse|Weg|Platz|Allee|Ring|Gasse)\s+\d{{1,4}}\s?[a-z]?\b"
    street_es = rf"(?:{'|'.join(w + tail for w, tail in _STREETS_ES.items())})\s+(?:de\s+(?:la\s+|los\s+|las\s+)?|del\s+)?\p{{L}}[\p{{L}}'’\-]*(?:\s+\p{{L}}[\p{{L}}'’\-]*){{0,3}}?,?\s+(?:n[º°.]?\s*)?\d{{1,4}}\s?[a-z]?\b"
    cue = rf"(?:{'|'.join(re.escape(head) + tail for head, tail in _CUES)})"
    return {
        "email": re.compile(rf"(?:mailto:)?(?P<local>{atom}(?:{dot}{atom})*)(?P<at>{at})(?P<host>{label}(?:{dot}{label})*{dot}(?P<tld>\p{{L}}{{2,}}))\b", flags),
        "introduced": re.compile(rf"\s+(?P<name>(?-i:\p{{Lu}})[\p{{L}}'’\-]+(?:\s+\p{{L}}\.)?(?:\s+{_PARTICLE}?(?-i:\p{{Lu}})[\p{{L}}'’\-]{{2,}}){{1,2}})(?!\s+(?-i:\p{{Lu}})\p{{L}})", flags),
        "dni": re.compile(r"(?<![\w\-./+])(?:\d{8}|[XYZ]-?\d{7})-?[A-Z](?![\w\-/]|\.\d)"),
        "before_at": re.compile(rf"(?r)(?:mailto:)?{atom}(?:{dot}{atom})*\s*[\[({{]?\s*", flags),
        "chunks": re.compile(r"(?r)(?:\S+\s+){1,8}"),
        "cued_id": re.compile(rf"\b{cue}\s*(?:is|was|number|no\.?|nr\.?|:|=|#)*\s*(?P<v>(?=[A-Z\d \-.]*\d)[A-Z]{{0,3}}[ \-.]?(?:[A-Z\d]*\d[A-Z\d]*)(?:[ \-.][A-Z\d]*\d[A-Z\d]*)*(?:[ \-]?[A-Z]\b)?)", flags),
        "bare_id": re.compile(r"(?<![\w\-./+])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PQR-TW-Z][A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w\-/]|\.\d)"),
        "phone": re.compile(
            r"(?<![\w\-./+=#@])(?<!\d )(?:"
            r"(?:\+|00)\d{1,3}(?:[ .\-/]?\(0\)[ .\-/]?|[ .\-/]?)(?:\(?\d{1,5}\)?(?:[ .\-/]?\d{2,8}){1,5})"
            r"|(?:1[ .\-])?(?:\(\d{3}\)[ .\-]?|\d{3}[.\-/ ])\d{3}[.\- ]\d{4}"
            r"|0\d{2,5}[ /\-]\d{3,8}(?:[ \-]\d{1,6}){0,2}"
            r"|\(0\d{2,5}\) ?\d{3,8}(?:[ \-]\d{1,6}){0,2}"
            r"|0[1-9](?:[ .]\d{2}){4}"
            r"|[679]\d{2} \d{3} \d{3}"
            r")(?:,?\s*(?:ext\.?|extension|x|app\.|durchwahl|poste)\s*\d{1,5})?(?![\w]|[\-./]\d)",
            flags,
        ),
        "not_number": re.compile(r"(?<![\p{L}])(?:part|parts|item|ticket|invoice|order|build|version|release|run|job|port|commit|error|code|session|turn|serial|sku|ref|reference|case|issue|bug|article|model|po|batch|lot|parcel|tracking|receipt|rechnung|bestellung|factura|facture|route|room|line|page|step|v)[\s.:#\-]*(?:id|no|nr|number|num|code|is)?[\s.:#\-]*(?:is\s+)?(?:[a-z]{1,3}-)?$", flags),
        "address": re.compile(rf"(?<![\w\-./])(?:{street_en}|{street_fr}|{street_es})(?:{_UNIT}){{0,2}}{place}|(?<![\w\-])(?:{street_de})(?:{_UNIT}){{0,2}}{place}", flags),
        "title": re.compile(rf"\b(?:{'|'.join(sorted({*TITLES, *_titles()}))})\.?\s+", flags),
        "after": re.compile(rf"\s*(?:{_NOT_AFTER})", flags),
        "rest": re.compile(rf"(?P<mid>(?:\s+\p{{L}}\.|\s+\p{{L}}(?=\s)){{0,2}})\s+(?P<part>{_PARTICLE}?)(?P<fam>{_NAME})", flags),
        "before": re.compile(rf"(?P<fam>(?:{_PARTICLE})?{_NAME}),\s*$", flags),
        "inits": re.compile(r"(?:\s+\p{L}\.(?!\p{L}))*"),
        "word": re.compile(rf"{_NAME}"),
    }


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    cues: dict[str, set[str]] = {}

    def add(kind: str, *words: str) -> None:
        for w in words:
            cues.setdefault(_flat(w), set()).add(kind)

    add("email", "@", "at", "&#64;")
    add("number", *(c for c in map(chr, range(0x20000)) if c.isdecimal()))
    add("id", *(head for head, _ in _CUES))
    add("numbered", *_STREETS_EN, *_STREETS_FR)
    add("named", *_STREETS_DE)
    add("leading", *_STREETS_ES)
    add("person", *GIVEN, *TITLES)
    add("introducing", *INTRODUCING)
    for w, kinds in cues.items():
        a.add_word(w, (frozenset(kinds), w))
    a.make_automaton()
    return a


#: spaces, hyphens and signs that look alike, one for one
_ALIKE = str.maketrans({**dict.fromkeys("\u00a0\u2007\u2009\u202f\u2002\u2003\u3000", " "), **dict.fromkeys("\u2010\u2011\u2012\u2013", "-"), "\uff20": "@", "\uff0e": "."})


def _flat(text: str) -> str:
    """Folded text of the same length, so that positions agree."""
    from strata.functions.text import _fold_table

    flat = text.translate(_fold_table()).lower()
    return flat if len(flat) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(_fold_table()))


#: what looked like a number of a kind and failed its check is no other kind either
_REFUSED = ""


class _Spans(list):
    """Disjoint (start, end, kind) in order of place."""

    def add(self, a: int, b: int, kind: str) -> None:
        insort(self, (a, b, kind))

    def overlaps(self, a: int, b: int) -> bool:
        at = bisect_left(self, (b,))
        return bool(at) and self[at - 1][1] > a


def _email_ok(m, text: str) -> bool:
    import regex as re

    at, host, tld = m["at"], m["host"], m["tld"].lower()
    literal = "@" in at or "64" in at
    if text[max(0, m.start() - 1) : m.start()] == "/" or re.match(r":?/|:[\w~.\-]+/", text[m.end() : m.end() + 40]):
        return False  # a user at a host, in an address of another scheme
    if not literal or " " in host:  # in disguise: a host that is only words must end like a host
        return bool(re.fullmatch(_TLD, tld)) and not (at.strip() == "at" and "." in host and "dot" not in host)
    return True


def _case(word: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if all(c.isupper() for c in letters) and len(letters) > 1:
        return "upper"
    return "title" if letters and letters[0].isupper() else "lower"


def _same_case(given: str, family: str) -> bool:
    bare = family.split("-", 1)[1] if family.lower().startswith(("al-", "el-")) else family
    g, f = _case(given), _case(bare)
    return g == f or (g == "title" and (f == "title" or any(c.isupper() for c in family[:3]))) or (g == "upper" and f == "upper")


def _anchors(flat: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of the anchors of each kind, in order of their ends."""
    hits: dict[str, list[tuple[int, int]]] = {}
    for end, (kinds, word) in _automaton().iter(flat):
        for kind in kinds:
            hits.setdefault(kind, []).append((end - len(word) + 1, end + 1))
    return hits


def _from(pattern, text: str, starts) -> Iterator:
    """The pattern's matches at the given starts, from left to right, without overlaps."""
    done = 0
    for s in sorted(set(starts)):
        if s >= done and (m := pattern.match(text, s)):
            yield m
            done = m.end()


#: no part of a mailbox or of its disguise lies further from its anchor than this
_REACH = 64 + 255


def _emails(text: str, hits: list[tuple[int, int]], p: dict) -> Iterator:
    """From each at-sign or its disguise to the left over the mailbox, then to the right over the host."""
    done = 0
    for a, b in hits:
        if a < done or (text[a].isalpha() and not (a and b < len(text) and (text[a - 1].isspace() or text[a - 1] in "[({") and (text[b].isspace() or text[b] in "])}"))):
            continue
        left = p["before_at"].match(text, max(done, a - _REACH), a)
        if left and (m := p["email"].match(text, left.start(), b + _REACH)) and m.start("at") <= a < m.end("at") and _email_ok(m, text):
            yield m
            done = m.end()


def _id_ok(found: str) -> bool:
    """What the authority that gave a number rules out."""
    digits = "".join(c for c in found if c.isdigit())
    if len(digits) == 9 and not any(c.isalpha() for c in found):
        return digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"
    return True


def _dni_ok(found: str) -> bool:
    body = found.replace("-", "").upper()
    number = int({"X": "0", "Y": "1", "Z": "2"}.get(body[0], body[0]) + body[1:-1])
    return body[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23]


def _cue_starts(flat: str, hits: list[tuple[int, int]]) -> list[int]:
    return [a for a, _ in hits if not (a and (flat[a - 1].isalnum() or flat[a - 1] == "_"))]


def _id_starts(text: str, runs: list[int]) -> list[int]:
    """Runs of digits, and two letters right before one, with or without a space."""
    return runs + [s for r in runs for s in (r - 2, r - 3) if s >= 0 and text[s].isalpha()]


def _phone_starts(text: str, runs: list[int]) -> list[int]:
    return runs + [r - 1 for r in runs if r and text[r - 1] in "+("]


def _street_starts(text: str, flat: str, hits: dict[str, list[tuple[int, int]]], runs: list[int], p: dict) -> list[int]:
    """Where an address around a street word may begin: a number before it, the name it ends or follows, or itself."""
    n, starts = len(flat), [a for a, _ in hits.get("leading", ())]
    for a, b in hits.get("numbered", ()):
        if runs and a and text[a - 1].isspace() and not (b < n and flat[b].isalnum()) and (left := p["chunks"].match(text, 0, a)):
            starts += runs[bisect_left(runs, left.start()) : bisect_left(runs, a)]
    for a, b in hits.get("named", ()):
        if b < n and text[b].isspace():
            s = _word_start(text, a)
            starts.append(s)
            if s == a and a and text[a - 1].isspace():
                starts.append(_word_start(text, a - 1))
    return starts


def _word_start(text: str, at: int) -> int:
    while at and (text[at - 1].isalpha() or text[at - 1] == "-"):
        at -= 1
    return at


def _matches(text: str, flat: str, hits: dict[str, list[tuple[int, int]]], p: dict) -> Iterator[tuple[str, Iterator]]:
    """Per parser, in the order in which kinds are settled, what it finds around its anchors."""
    runs = [a for a, _ in hits.get("number", ()) if not (a and text[a - 1].isdecimal())]
    if "email" in hits:
        yield "email", _emails(text, hits["email"], p)
    if runs:
        if "id" in hits:
            yield "cued_id", _from(p["cued_id"], text, _cue_starts(flat, hits["id"]))
        yield "bare_id", _from(p["bare_id"], text, _id_starts(text, runs))
        yield "dni", _from(p["dni"], text, _id_starts(text, runs) + [r - 1 for r in runs if r and text[r - 1].isalpha()])
        yield "phone", _from(p["phone"], text, _phone_starts(text, runs))
        yield "address", _from(p["address"], text, _street_starts(text, flat, hits, runs, p))


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of place, without overlaps."""
    text = text.translate(_ALIKE)
    flat = _flat(text)
    hits = _anchors(flat)
    if not hits:
        return []
    p = _patterns()
    spans = _Spans()
    for name, found in _matches(text, flat, hits, p):
        for m in found:
            if name == "email":
                spans.add(m.start(), m.end(), "email")
            elif name == "cued_id":
                if sum(c.isdigit() for c in m["v"]) >= 4 and not spans.overlaps(*m.span("v")):
                    spans.add(*m.span("v"), "id_number" if _id_ok(m["v"]) else _REFUSED)
            elif spans.overlaps(*m.span()):
                continue
            elif name == "address":
                spans.add(m.start(), m.end(), "address")
            elif name == "dni" and not _dni_ok(m[0]) or name == "bare_id" and not _id_ok(m[0]):
                spans.add(m.start(), m.end(), _REFUSED)
            elif not p["not_number"].search(text, max(0, m.start() - 24), m.start()) and (name != "phone" or 8 <= sum(c.isdigit() for c in m[0]) <= 19):
                spans.add(m.start(), m.end(), "phone" if name == "phone" else "id_number")
    if "person" in hits:
        _persons(text, flat, hits["person"], spans, p)
    for a, b in hits.get("introducing", ()):
        m = None if a and flat[a - 1].isalnum() else p["introduced"].match(text, b)
        if m and not spans.overlaps(*m.span("name")) and not p["after"].match(text, m.end()) and not _NO_NAME & {w.lower() for w in m["name"].split()}:
            spans.add(*m.span("name"), "person")
    return [x for x in spans if x[2] != _REFUSED]


def _persons(text: str, flat: str, names: list[tuple[int, int]], spans: _Spans, p: dict) -> None:
    done = -1
    for a, b in sorted(names, key=lambda x: (x[0], -x[1])):
        if a < done or (a and (flat[a - 1].isalnum() or flat[a - 1] in "@_")) or (b < len(flat) and (flat[b].isalnum() or flat[b] in "@_")):
            continue
        if flat[a:b] in _titles():  # a title makes any capital word after it a given name
            t = p["title"].match(text, a)
            w = t and p["word"].match(text, t.end())
            if not w or _case(w[0]) == "lower" and flat[w.start() : w.end()] not in GIVEN:
                continue
            start, g0, g1 = a, w.start(), w.end()
            if flat[g0:g1] in _titles():
                continue
        else:
            w = p["word"].match(text, a)
            if not w or w.end() != b:  # part of a hyphenated or longer word
                if not w or "-" not in w[0]:
                    continue
            start, g0, g1 = a, a, w.end()
        family = _family(text, flat, g0, g1, p)
        if family is None:
            back = p["before"].search(text, max(0, g0 - 60), g0) if start == g0 else None
            if back and _family_ok(text, g0, g1, *back.span("fam")) and back.start("fam") >= done and not _is_given(flat, *back.span("fam")):
                start, end = back.start("fam"), g1
                end = p["inits"].match(text, end).end()
                more = p["word"].match(text, end + 1) if text[end : end + 1] == " " else None
                if more and _is_given(flat, *more.span()):
                    end = more.end()
            else:
                continue
        else:
            end = family
        if spans.overlaps(start, end) or p["after"].match(text, end):
            continue
        spans.add(start, end, "person")
        done = end


@cache
def _givens() -> frozenset[str]:
    return frozenset(GIVEN)


@cache
def _titles() -> frozenset[str]:
    return frozenset(map(_flat, TITLES))


def _is_given(flat: str, a: int, b: int) -> bool:
    return flat[a:b] in _givens()


def _family_ok(text: str, g0: int, g1: int, f0: int, f1: int) -> bool:
    given, family = text[g0:g1], text[f0:f1].split()[-1]
    return len(family) >= 3 and family.lower() not in PLAIN and _same_case(given, family)


def _family(text: str, flat: str, g0: int, g1: int, p: dict) -> int | None:
    """End of the family name after the given name at g0..g1 (further given names and initials between), or None."""
    at, last = g1, None
    for _ in range(4):
        m = p["rest"].match(text, at)
        if not m:
            break
        f0, f1 = m.span("fam")
        if not _family_ok(text, g0, g1, f0, f1):
            break
        if _is_given(flat, f0, f1) and not m["part"]:
            at = f1
            after = p["rest"].match(text, at)
            if not (after and _family_ok(text, g0, g1, *after.span("fam"))):
                last = f1 if last is None else last
                break
            continue
        return f1
    return last


_MARKS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}


def redact_text(text: str | None) -> str | None:
    """The text with typed placeholders for its spans; all else as it was."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_spans(text):
        out += [text[at:a], _MARKS[kind]]
        at = b
    return "".join(out) + text[at:]


def _span_batches(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, nos, starts, ends = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                seen: dict[str, int] = {}
                for a, b, kind in find_spans(text):
                    seen[kind] = seen.get(kind, 0) + 1
                    rows.append(i)
                    kinds.append(kind)
                    nos.append(seen[kind])
                    starts.append(a)
                    ends.append(b)
            kept = batch.select(keys).take(pa.array(rows, pa.int64()))
            new = [pa.array(kinds, pa.string()), pa.array(nos, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *new], [*keys, "kind", "span_no", "span_start", "span_end"])

    return run


def spans(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per span: keys, kind, span_no (from 1 within the text and kind), span_start, span_end."""
    cols = spread(df.select(*keys, df[text].alias("text")))
    kinds = dict(cols.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", kind string, span_no int, span_start int, span_end int"
    return cols.mapInArrow(_span_batches(keys), schema)


def redact(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, text) with placeholders; null and empty texts as they are."""
    cols = spread(df.select(*keys, df[text].alias("text")))
    kinds = dict(cols.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pa.array([redact_text(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, done], [*keys, "text"])

    return cols.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string")
