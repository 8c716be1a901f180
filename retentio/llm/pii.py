"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Kinds: e-mail addresses, telephone numbers, IPv4 addresses, payment card and account numbers, IBANs, secrets (values assigned
to password- or token-like names, long hexadecimal strings), and the parts of personal names after a form of address, also
where they stand without one in the same text.
An entity's normal form (lower case, bare digits, ...) is what two mentions must share to be the same entity. Its
surrogate is drawn by HMAC from the key, the kind and the normal form, so the same entity gets the same surrogate in
every document and every run with that key, and nothing can be recovered without it. The surrogate is then written
in the format of each mention: separators, letter case and script stay; card and IBAN checksums that held
still hold, and those that did not still do not; given names keep the gender of the form of address.

Distinctness: the distinct entities of the corpus form a table. Surrogates that two entities of a kind share, or
that are themselves an entity of the corpus, are found by grouping; all but the first entity draw again, until none
collide. An entity that finds no free surrogate of its own length gets a longer one.

Plan: one scan finds the entities; only documents that have some go on, written once. Entities are pre-aggregated before they
move; the surrogates come back by a join on the entity that adaptive execution splits where one entity fills a
third of the mentions; texts are rewritten next to their mentions.

Defined cases: null, empty and entity-free texts give no row in :func:`pseudonymised` and pass :func:`rewrite` and
:func:`pseudonymised_rows` unchanged;
adjacent numbers are told apart by their groupings and checksums, and
overlapping finds that remain keep the earliest, then the longest; null ids stay null; repeated rows are each
rewritten alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import keyed, packed, real_id, saved, small_batches

# Attempts that draw in the entity's own length; every later one draws from a space at least ten times as large.
SAME_LENGTH = 8

# Forms of address by gender, and given names and surname parts by script.
ADDRESS = {
    "m": ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor"],
}
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Julian", "Leon", "Marco", "Oscar", "Paul", "Robert", "Simon", "Victor"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Helena", "Irene", "Julia", "Laura", "Maria", "Olga", "Paula", "Rosa", "Silvia", "Vera"],
    ("latin", "n"): ["Alex", "Ariel", "Chris", "Dominique", "Eden", "Jean", "Kim", "Lou", "Maxime", "Noa", "Robin", "Sam", "Sascha", "Toni"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Олег", "Павел", "Сергей"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Полина", "Светлана"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Шура"],
    ("greek", "m"): ["Αλέξανδρος", "Γεώργιος", "Δημήτριος", "Ιωάννης", "Κωνσταντίνος", "Νικόλαος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "n"): ["Αλεξ"],
}
SYLLABLES = {
    "latin": ["bar", "cal", "den", "far", "gor", "hol", "jan", "kel", "lam", "mor", "nor", "pel", "ros", "sal", "tor", "ven", "wil", "zan"],
    "cyrillic": ["бор", "вал", "гор", "дан", "зим", "кор", "лан", "мир", "нор", "пет", "рос", "сал", "тар", "фед"],
    "greek": ["βαλ", "γαρ", "δημ", "καλ", "λαμ", "μαρ", "νικ", "παπ", "ραλ", "σαρ", "ταλ", "φιλ"],
}
ENDINGS = {"latin": ["er", "in", "o", "son", "ay", "ez"], "cyrillic": ["ов", "ин", "ко", "ский"], "greek": ["ης", "ος", "ας", "ίδης"]}

_TITLE = {t.casefold(): g for g, ts in ADDRESS.items() for t in ts}
_NAME = r"[^\W\d_a-zà-öø-ÿа-яёα-ωά-ώ][^\W\d_]+"
NAMES = re.compile(r"\b(" + "|".join(sorted((t for ts in ADDRESS.values() for t in ts), key=len, reverse=True)) + rf")\.?[  ]({_NAME}(?:[ -]{_NAME})?)")
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
DIGITS = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,}")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")
NANP = re.compile(r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)")
# Lengths of the digit groups that cards are written in, besides 13 to 19 digits in one.
GROUPS = [(4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 3), (4, 6, 4), (4, 4, 4, 2), (4, 4, 4, 1)]
USUAL = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)]
SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?((?=[_+/.=-]*[A-Za-z0-9])[A-Za-z0-9_+/.=-]{8,})")
HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")


# ---------------------------------------------------------------- finding

def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_holds(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def script_of(name: str) -> str:
    c = name[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers whose checksum holds; a following word that the pattern takes along is left out again."""
    pos = 0
    while m := IBAN.search(text, pos):
        start, stop, pos = m.start(), m.end(), m.start() + 1
        while stop - start >= 12:
            bare = text[start:stop].replace(" ", "")
            if len(bare) >= 12 and iban_holds(bare):
                yield start, stop
                pos = stop
                break
            stop = text.rfind(" ", start, stop)


def _cards(text: str, others: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """Card and account numbers among the digit groups that touch none of ``others``, and whether their grouping
    marks them as such. Of adjacent groups, cards in a known grouping whose checksum holds go first, then solid numbers,
    then what is left over if it is as long as a card, then cards in the usual groupings."""

    def solid(piece, i):
        return 1 if 13 <= piece[i][1] - piece[i][0] <= 19 else 0

    def grouped(piece, i, shapes):
        lengths = tuple(b - a for a, b in piece[i:i + 5])
        return (len(s) for s in shapes if lengths[:len(s)] == s)

    def valid(piece, i):
        found = [*[1] * solid(piece, i), *grouped(piece, i, GROUPS)]
        return next((k for k in found if luhn(digits_of(text[piece[i][0]:piece[i + k - 1][1]]))), 0)

    def whole(piece, i):
        return len(piece) if i == 0 and 13 <= sum(b - a for a, b in piece) <= 19 else 0

    def usual(piece, i):
        return next(grouped(piece, i, USUAL), 0)

    for m in DIGITS.finditer(text):
        groups = [(g.start(), g.end()) for g in re.compile(r"\d+").finditer(text, m.start(), m.end())]
        pieces: list[list[tuple[int, int]]] = [[]]
        for a, b in groups:
            # Parts of decimals and of versions are no cards, nor is what belongs to another find.
            if (text[a - 1:a] == "." and text[a - 2:a - 1].isdigit() or text[b:b + 1] == "." and text[b + 1:b + 2].isdigit()
                    or any(x < b and a < y for x, y in others)):
                pieces.append([])
            else:
                pieces[-1].append((a, b))
        for rule in (valid, solid, whole, usual):
            rest = []
            for piece in pieces:
                start = i = 0
                while i < len(piece):
                    if k := rule(piece, i):
                        yield piece[i][0], piece[i + k - 1][1], rule is not whole
                        rest.append(piece[start:i])
                        start = i = i + k
                    else:
                        i += 1
                rest.append(piece[start:])
            pieces = [x for x in rest if x]


def _phones(text: str, stops: list[int]) -> Iterator[tuple[int, int]]:
    """Telephone numbers, cut at the first of ``stops`` if what is left is one. After +1 come ten digits."""
    pos = 0
    while m := PHONE.search(text, pos):
        start, pos = m.span()
        if exact := NANP.match(text, start):
            pos = exact.end()
        elif at := next((x for x in stops if start < x < pos), 0):
            short = PHONE.match(text, start, at)
            if short and len(digits_of(short.group())) >= 7:
                pos = short.end()
        if len(digits_of(text[start:pos])) >= 7:
            yield start, pos


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The parts of names after a form of address, and wherever else in the text they stand, as written there, capitalised
    or in capitals. A neutral form of address takes the gender that another one gives the same name in this text."""
    found, genders, last_parts = [], {}, set()
    for m in NAMES.finditer(text):
        gender, at = _TITLE[m.group(1).casefold()], m.start(2)
        parts = [(p.start() + at, p.group()) for p in re.finditer(r"[^ -]+", m.group(2))]
        found.append((gender, parts))
        for _, part in parts[:-1]:
            genders.setdefault(part.casefold(), set()).add(gender)
        if len(parts) > 1:
            last_parts.add(parts[-1][1].casefold())
    if not found:
        return
    forms: dict[str, tuple[str, str]] = {}
    titled = set()
    for gender, parts in found:
        for k, (start, part) in enumerate(parts):
            norm = part.casefold()
            given = k < len(parts) - 1 or len(parts) == 1 and norm in genders and norm not in last_parts
            if given and gender == "n" and len(genders[norm] - {"n"}) == 1:
                gender_ = next(iter(genders[norm] - {"n"}))
            else:
                gender_ = gender
            kind = f"name-{'given-' + gender_ if given else 'surname'}-{script_of(part)}"
            titled.add(start)
            for form in (part, part.upper(), part[:1] + part[1:].lower()):
                forms.setdefault(form, (kind, norm))
            yield start, start + len(part), kind, norm
    for m in re.finditer(r"[^\W\d_]+", text):
        if m.group() in forms and m.start() not in titled and not re.match(r"[\d_]", text[m.end():m.end() + 1]) and not re.match(r"[\d_]", text[m.start() - 1:m.start()]):
            yield m.start(), m.end(), *forms[m.group()]


def _finds(text: str) -> Iterator[tuple[int, int, str, str]]:
    others = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            others.append(m.span())
            yield m.start(), m.end(), "email", m.group().lower()
    for m in IP.finditer(text):
        others.append(m.span())
        yield m.start(), m.end(), "ip", m.group()
    for a, b in _ibans(text):
        others.append((a, b))
        yield a, b, "iban", text[a:b].replace(" ", "")
    stops = [a for a, _ in others]
    others += [m.span() for m in NANP.finditer(text)] if "+1" in text else []
    for a, b, marked in _cards(text, others):
        stops += [a] * marked
        yield a, b, "card", digits_of(text[a:b])
    for a, b in _phones(text, sorted(stops)):
        yield a, b, "phone", ("+" if text[a] == "+" else "") + digits_of(text[a:b])
    if ":" in text or "=" in text:
        for m in SECRET.finditer(text):
            yield m.start(1), m.end(1), "secret", m.group(1)
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "secret", m.group()
    yield from _names(text)


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, stop, kind, normal form)`` of the entities, without overlaps."""
    out: list[tuple[int, int, str, str]] = []
    for e in sorted(_finds(text or ""), key=lambda e: (e[0], -e[1], e[2])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


# ---------------------------------------------------------------- drawing

class Draw:
    """Numbers drawn by HMAC from the key and what they are for."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.what = key, "\x1f".join(map(str, what)).encode()
        self.pool, self.round = 0, 0
        self.size = 1

    def below(self, n: int) -> int:
        if self.size < n << 32:
            block = hmac.new(self.key, self.what + b"\x1f%d" % self.round, hashlib.sha256).digest()
            self.pool, self.size, self.round = int.from_bytes(block, "big"), 1 << 256, self.round + 1
        self.pool, out = divmod(self.pool, n)
        self.size //= n
        return out

    def like(self, s: str) -> str:
        """Letters for letters of the same case, digits for digits; hexadecimal letters stay hexadecimal."""
        hexa = all(c in "0123456789abcdefABCDEF" for c in s)
        out = []
        for c in s:
            if c.isdigit():
                out.append(chr(48 + self.below(10)))
            elif c.isascii() and c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + self.below(6 if hexa else 26)))
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The normal form that stands for ``norm``. From attempt ``SAME_LENGTH`` on it is drawn longer and longer (addresses:
    past their range, then past valid ones), so that no number of entities uses the space up."""
    draw = Draw(key, kind, norm, attempt)
    more = max(0, attempt + 1 - SAME_LENGTH)
    if kind == "email":
        local, domain = norm.rsplit("@", 1)
        labels = domain.split(".")
        keep = 2 if labels[-2:-1] == ["example"] else 1  # the reserved example domain stays as it is
        named = Draw(key, "domain", domain)  # one domain, one surrogate domain
        return draw.like(local + "a" * more) + "@" + ".".join([named.like(x) for x in labels[:-keep]] + labels[-keep:])
    if kind == "ip":
        first = int(norm.split(".")[0])
        if more > SAME_LENGTH:  # no valid address is one of these
            return ".".join(str(256 + draw.below(744)) for _ in range(4))
        if more:
            first = 1 + draw.below(223)
        rest = [str(draw.below(256)) for _ in range(2)] + [str(1 + draw.below(254))]
        return ".".join([str(first) if first in (10, 127) else str(11 + draw.below(112)) if first < 128 else str(128 + draw.below(96)), *rest])
    if kind == "card":
        body = norm[0] + "".join(str(draw.below(10)) for _ in norm[1:-1] + "0" * more)
        right = next(c for c in "0123456789" if luhn(body + c))
        return body + (right if luhn(norm) else str((int(right) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = draw.like(norm[4:] + "0" * more)
        rest = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return norm[:2] + f"{98 - rest:02d}" + body
    if kind == "phone":
        keep = 2 if norm[0] == "+" else 0  # the plus sign and the first digit of the country code
        return norm[:keep] + "".join(str(draw.below(10)) for _ in norm[keep:] + "0" * more)
    if kind.startswith("name-"):
        part, script = kind.split("-", 1)[1].rsplit("-", 1)
        if part.startswith("given-"):
            names = GIVEN[script, part[-1]]
            # Where the list does not suffice, further given names keep people apart, and then a made-up one.
            given = [names[draw.below(len(names))] for _ in range(1 + min(attempt, SAME_LENGTH) // 3)]
            made = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(more))
            return "-".join([*given, *[made] * bool(made)]).casefold()
        parts = SYLLABLES[script]
        return ("".join(parts[draw.below(len(parts))] for _ in range(2 + more)) + ENDINGS[script][draw.below(len(ENDINGS[script]))]).casefold()
    return draw.like(norm + next(c for c in norm if c.isalnum()) * more)


def write_like(mention: str, kind: str, norm: str) -> str:
    """The surrogate's normal form in the format of the mention."""
    if kind in ("card", "phone"):
        digits = iter(digits_of(norm))
        return "".join([next(digits, "") if c.isdigit() else c for c in mention]) + "".join(digits)
    if kind == "iban":
        chars = iter(norm)
        return "".join([c if c == " " else next(chars, "") for c in mention]) + "".join(chars)
    if kind == "email" or kind.startswith("name-"):
        if mention.isupper() and len(mention) > 1:
            return norm.upper()
        if kind == "email":
            return norm
        return "-".join(x[:1].upper() + x[1:] for x in norm.split("-"))
    return norm


# ---------------------------------------------------------------- Spark jobs

SPANS = "spans array<struct<start: int, stop: int, kind: string, norm: string>>"


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _th, _text, spans)`` of the documents with entities."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [find(t) for t in batch.column(2).to_pylist()]
            rows = pa.array([i for i, x in enumerate(found) if x], pa.int32())
            spans = [[{"start": a, "stop": b, "kind": k, "norm": n} for a, b, k, n in x] for x in found if x]
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(spans, kind)], ["_id", "_th", "_text", "spans"])

    return keyed(docs, id_col, text_col).mapInArrow(run, f"_id long, _th long, _text string, {SPANS}")


def draw_all(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    """``(kind, norm, surrogate)`` of this attempt."""

    def run(batches):
        for batch in batches:
            out = [surrogate(key, k, n, attempt) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["kind", "norm", "surrogate"])

    return entities.select("kind", "norm").mapInArrow(run, "kind string, norm string, surrogate string")


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``(kind, norm, surrogate)`` with one surrogate per entity and one entity per surrogate; no surrogate is an
    entity of the corpus. Each round settles who drew a free surrogate and lets the others draw again; as the space
    grows with the attempts, the number of rounds grows with the logarithm of the number of entities."""
    settled, open_ = None, entities
    for attempt in itertools.count():
        drawn = draw_all(open_, key, attempt)
        taken = entities.select("kind", F.col("norm").alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "surrogate"))
        free = drawn.join(taken.distinct(), ["kind", "surrogate"], "left_anti")
        won = saved(free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).select("kind", "norm", "surrogate"))
        settled = won if settled is None else saved(settled.unionByName(won))
        open_ = saved(open_.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if open_.isEmpty():
            return settled


def gendered(entities: DataFrame) -> DataFrame:
    """``(kind, norm, as_kind)`` of the given names after a neutral form of address only, in their text, whose gender
    other texts tell: the gender they go by, if it is one."""
    part, script = F.regexp_extract("kind", "^name-given-([mfn])-", 1), F.regexp_extract("kind", "([a-z]+)$", 1)
    given = entities.where(part != "").select("kind", "norm", script.alias("script"), part.alias("gender"))
    known = given.where("gender <> 'n'").groupBy("script", "norm").agg(F.min("gender").alias("lo"), F.max("gender").alias("hi")).where("lo = hi")
    return given.where("gender = 'n'").join(known, ["script", "norm"]).select(
        "kind", "norm", F.concat_ws("-", F.lit("name-given"), "lo", "script").alias("as_kind"))


def drawn_table(entities: DataFrame, key: bytes) -> DataFrame:
    """``(kind, norm, surrogate)``: :func:`surrogates`, with names of one gender drawn once."""
    alike = saved(gendered(entities))
    if alike.isEmpty():
        return surrogates(entities, key)
    own = surrogates(saved(entities.join(alike.select("kind", "norm"), ["kind", "norm"], "left_anti")), key)
    same = alike.join(own.withColumnRenamed("kind", "as_kind"), ["as_kind", "norm"]).select("kind", "norm", "surrogate")
    return own.unionByName(same)


def replaced(docs: DataFrame, key: bytes, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _th, text, entities)`` of the documents with entities, one per distinct row key."""
    found = saved(mentions(docs, id_col, text_col).dropDuplicates(["_id", "_th"]))
    spans = found.select("_id", "_th", F.explode("spans").alias("s")).select("_id", "_th", "s.*")
    table = saved(drawn_table(saved(spans.groupBy("kind", "norm").agg(F.count("*").alias("n"))), key))
    drawn = saved(spans.select("_id", "_th", "start", "kind", "norm")).join(table, ["kind", "norm"])
    by_doc = drawn.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("start", "surrogate"))).alias("drawn"))

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, entities = [], []
            for text, spans, drawn in zip(*(c.to_pylist() for c in batch.columns[2:])):
                out, at, told = [], 0, []
                for s, d in zip(spans, drawn):
                    new = write_like(text[s["start"]:s["stop"]], s["kind"], d["surrogate"])
                    out += [text[at:s["start"]], new]
                    at = s["stop"]
                    told.append({"kind": s["kind"], "start": s["start"], "stop": s["stop"], "surrogate": new})
                texts.append("".join(out) + text[at:])
                entities.append(told)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(entities, kind)],
                                             ["_id", "_th", "text", "entities"])

    schema = "_id long, _th long, text string, entities array<struct<kind: string, start: int, stop: int, surrogate: string>>"
    return found.join(by_doc, ["_id", "_th"]).select("_id", "_th", "_text", "spans", "drawn").mapInArrow(run, schema)


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_entities, entities, text)`` of every distinct document that holds personal data, rewritten."""
    out = replaced(docs, key, id_col, text_col)
    return out.select(real_id().alias(id_col), F.size("entities").cast("long").alias("n_entities"), "entities", "text")


def pseudonymised_rows(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_entities, entities, text)`` of every row, rewritten; without personal data, ``n_entities`` is 0, ``entities``
    empty and the text as it was."""
    new = saved(replaced(docs, key, id_col, text_col).select("_id", "_th", F.col("text").alias("_new"), "entities"))
    joined = keyed(docs, id_col, text_col).join(new, ["_id", "_th"], "left")
    entities = F.coalesce("entities", F.array().cast(new.schema["entities"].dataType))
    return joined.select(real_id().alias(id_col), F.size(entities).cast("long").alias("n_entities"), entities.alias("entities"),
                         F.coalesce("_new", "_text").alias("text"))


def rewrite(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, personal data in ``text_col`` replaced."""
    new = saved(replaced(docs, key, id_col, text_col).select("_id", "_th", F.col("text").alias("_new")))
    joined = packed(docs, id_col, text_col).join(new, ["_id", "_th"], "left")
    return joined.select(*[F.coalesce("_new", F.col("_row")[c]).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
