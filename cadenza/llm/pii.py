"""Surrogates for personal data (operator 1).

Entities found in a text are replaced by surrogates of their type: a phone
number keeps its punctuation and country code, a card number its check digit, a
name its script, its case and the gender that a title gave it.  A surrogate is
drawn from an HMAC of the entity under a secret key, so that it says nothing
about the entity without the key and the same entity has the same surrogate in
every document, however it is written there (coreference).

Distinct entities stay distinct: a table of all entities of the corpus is
resolved in rounds.  A surrogate that another entity holds already or that two
entities drew goes to at most one of them, one that an entity of the corpus
really has to none; the others draw again.  A format may have fewer values than
the corpus has entities, so every STEP draws a surrogate gets one character more
than the format has (an IP address becomes one of version 6): what is left over
then draws from a supply that grows tenfold a step, and the rounds end.  The
table is joined back by the digest of the texts, so that texts without entities
are never shuffled.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import keep_caches, materialize, others

#: Draws within a format before surrogates become a character longer.
STEP = 8

# Titles with the gender they give, and how names are built.
_TITLES = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Госпожа", "г-жа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
_GENDER = {t: g for g, titles in _TITLES.items() for t in titles}
_SCRIPTS = {
    "latin": (tuple("ba be bi da de do fa ga ka ke la le li lo ma me mi na ne no ra re ri ro sa se ta te ti to va vi".split()),
              {"m": ("n", "r", "s", "do"), "f": ("na", "la", "ra", "lia"), "n": ("n", "l"), "s": ("ner", "ton", "mann", "ley")}),
    "cyrillic": (tuple("ба бе ви га да де ка ла ле ли ма ми на не ра ре са се та ти".split()),
                 {"m": ("н", "р", "й"), "f": ("на", "ла", "я"), "n": ("н", "л"), "s": ("ков", "нин", "ский")}),
    "greek": (tuple("βα γα δα δη θε κα λα λε μα μι να νι ρα ρε σα σο τα τι".split()),
              {"m": ("ς", "ων"), "f": ("να", "ρα", "λη"), "n": ("ν",), "s": ("δης", "κος", "λος")}),
}


def _of_category(*categories: str) -> str:
    """Ranges of a character class: the letters of these Unicode categories."""
    out, first = [], None
    for i in range(0x20000):            # planes 0 and 1, which end on no letter
        if unicodedata.category(chr(i)) in categories:
            first = i if first is None else first
        elif first is not None:
            out.append(f"{chr(first)}-{chr(i - 1)}")
            first = None
    return "".join(out)


# A name: any number of parts, each a word with a capital, initials or a short
# form with a dot, with particles before it that stay as they are.
_UPPER = f"[{_of_category('Lu', 'Lt')}]"
_GAP = "[ \u00a0]+"
_TITLE = r"(?:" + "|".join(sorted(_GENDER, key=len, reverse=True)) + r")\b\.?"
_PARTICLE = (r"(?:von|vom|van|vander|zu|zum|zur|der|den|dem|des|de|del|della|di|da|do|dos|das|du|la|las|le|les|los|"
             r"y|e|af|av|ten|ter|bin|ibn|al|el|фон|де|ван)\b")
_PART = (rf"(?:(?:{_UPPER}[\u0300-\u036f]*\.-?)+|(?:St|Ste|Th|Ph|Ch|Chr|Wm|Jos|Joh|Geo|Fr)\.(?={_GAP}{_UPPER})"
         rf"|(?:[dlDL]['’]|al-|el-)?{_UPPER}[\w’'\u0300-\u036f-]*)")
_NAME = rf"(?:{_PARTICLE}{_GAP})*{_PART}"
_TITLES_OF = re.compile(rf"\b{_TITLE}(?:{_GAP}{_TITLE}(?={_GAP}))*")
_PARTS_OF = re.compile(rf"{_GAP}(?:{_PARTICLE}{_GAP})*(?P<part>{_PART})")
#: What may follow a surname and is none.
_AFTER = {"Jr", "Jr.", "Sr", "Sr.", "II", "III", "IV"}

# Phones have 7 digits or more: with + or 00 and a country code; with an area in
# brackets; 3-3-4, also after 1; pairs after 0 (fr); an area with 0 and groups
# (de, en); nine digits from 6 on (es); 0 and at least eight digits; 3-4.
_PHONE = "|".join((
    r"(?:(?:\+|00)[0-9]{1,3}[ .-]?|1[ .-]?)?\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)",
    r"(?:\+|00(?=[1-9]))[0-9]{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?[0-9]{1,4}){2,6}(?!\w)",
    r"(?<!-)(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])",
    r"(?<!-)0[1-9](?:[ .-][0-9]{2}){4}(?![\w-])",
    r"(?<!-)0[1-9][0-9]{1,3}[ /-][0-9]{2,8}(?:[ -][0-9]{2,6}){0,3}(?![\w-])",
    r"(?<!-)[6-9][0-9]{2}(?: [0-9]{3} [0-9]{3}|(?: [0-9]{2}){3})(?![\w-])|(?<!-)[89][0-9] [0-9]{3} [0-9]{2} [0-9]{2}(?![\w-])",
    r"(?<!-)0[1-9][0-9]{7,10}(?![\w-])",
    r"(?<!-)[0-9]{3}-[0-9]{4}(?![\w-])",
))
_FINDER = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:api[_-]?key|access[_-]?key|token|secret|passwd|password|bearer)\b[\"']?\s*[:=]?\s*[\"']?"
              r"(?=[\w/+.-]*[0-9])[\w/+.-]{12,}"
              # after a sign also shorter ones, and those in quotes without a digit
              r"|\b(?:api[_-]?key|access[_-]?key|token|secret|passwd|password|bearer)\b[\"']?\s*[:=]\s*"
              r"(?:[\"'](?=[\w/+.-]+[\"'])|[\"']?(?=[\w/+.-]*[0-9]))(?=(?:[_/+.-]*[^\W_]){6})[\w/+.-]{6,})",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])",
    "card": r"(?<![\w.])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?!\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w.])(?=[+(0-9](?:[ ./()-]{0,3}[0-9]){6})(?:" + _PHONE + ")",
    "hex": r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}\b|\b(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{32,}\b",
    "name": rf"\b{_TITLE}(?:{_GAP}{_TITLE}(?={_GAP}))*{_GAP}{_NAME}(?:{_GAP}{_NAME})*",
}.items()))
_SECRET_VALUE = re.compile(r"[\w/+.-]+$")


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


# The country codes of one digit, and those of two.
_ONE_DIGIT = "1 7".split()
_TWO_DIGITS = ("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
               "81 82 84 86 90 91 92 93 94 95 98").split()


def national(phone: str) -> str:
    """A phone's number within its country, without the trunk's 0: what the ways
    to write it have in common.  All digits, if hardly any are left."""
    digits = _digits(phone)
    rest = digits
    if phone.startswith("+") or digits.startswith("00"):
        rest = digits.lstrip("0")
        rest = rest[1 if rest[:1] in _ONE_DIGIT else 2 if rest[:2] in _TWO_DIGITS else 3:]
    elif len(digits) == 11 and digits[0] == "1":
        rest = digits[1:]
    rest = rest.lstrip("0")
    return rest if len(rest) >= 4 else digits


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text in order: start, end, type and key.  The key is what
    mentions of one entity have in common."""
    spans, names = [], {}
    for m in _FINDER.finditer(text):
        kind, start, end, found = m.lastgroup, m.start(), m.end(), m.group()
        if kind == "email":
            spans.append((start, end, kind, found.lower()))
        elif kind in ("secret", "hex"):
            value = _SECRET_VALUE.search(found).group().rstrip(".")
            at = start + found.rindex(value)
            spans.append((at, at + len(value), "secret", value))
        elif kind == "name":
            titles = _TITLES_OF.match(found)
            genders = [_GENDER[t.rstrip(".")] for t in re.split(_GAP, titles.group())]
            gender = next((g for g in genders if g != "n"), "n")
            parts = [(p.start("part"), p["part"]) for p in _PARTS_OF.finditer(found, titles.end())]
            while len(parts) > 1 and parts[-1][1] in _AFTER:
                parts.pop()
            for i, (at, part) in enumerate(parts):
                at += start
                letters = re.sub("[.\u0300-\u036f-]", "", part)
                if len(letters) == 1 or "." in part:        # each letter of initials; a short form as one
                    if part[1:2].islower():
                        spans.append((at, at + len(part) - 1, f"given_{gender}", part[:-1].casefold()))
                    else:
                        spans += [(at + j, at + j + 1, "initial", c.casefold()) for j, c in enumerate(part) if c.isalpha()]
                    continue
                part = part[:-2] if part[-2:] in ("’s", "'s") else part
                key = (f"given_{gender}" if i < len(parts) - 1 else "surname", part.casefold())
                if len(part) >= 3:
                    names.setdefault(part, key)
                spans.append((at, at + len(part), *key))
        elif kind == "iban":
            spans.append((start, end, kind, found.replace(" ", "")))
        elif kind == "ip":
            spans.append((start, end, kind, found))
        else:
            # the country code is no part of a phone's key
            spans.append((start, end, kind, national(found) if kind == "phone" else _digits(found)))
    if names:           # the same names without a title
        taken = sorted(spans)
        starts = [s for s, *_ in taken]
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b", text):
            i = bisect_left(starts, m.end())
            if not i or taken[i - 1][1] <= m.start():
                spans.append((m.start(), m.end(), *names[m.group()]))
    return sorted(spans)


class _Draw:
    """Numbers from the HMAC of an entity and the count of draws before."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed = key, f"{kind}\0{entity}\0{attempt}".encode()
        self.pool, self.block = 0, 0
        self.size = 1

    def below(self, n: int) -> int:
        if self.size < n << 32:
            digest = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.size = int.from_bytes(digest, "big"), 1 << 256
            self.block += 1
        self.pool, out = divmod(self.pool, n)
        self.size //= n
        return out


def _luhn(digits: str) -> int:
    """Sum of the check; a valid number has a multiple of ten."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits)))


def _alike(text: str, draw: _Draw, more: int = 0) -> str:
    """Other letters and digits of the same kinds, the rest as it is; then
    ``more`` others, one at least if nothing in the text can be another."""
    out = []
    hexadecimal = len(text) >= 16 and re.fullmatch("[0-9]*[a-f][0-9a-f]*|[0-9]*[A-F][0-9A-F]*", text)
    for i, c in enumerate(text):
        if hexadecimal:
            d = "0123456789abcdef"[draw.below(16)]
            out.append(d if text == text.lower() else d.upper())
        elif "0" <= c <= "9":
            out.append("0123456789"[draw.below(10)] if i or c == "0" else "123456789"[draw.below(9)])
        elif c.isalpha():
            d = "abcdefghijklmnopqrstuvwxyz"[draw.below(26)]
            out.append(d.upper() if c.isupper() else d)
        elif c.isdecimal():         # digits of other scripts
            out.append(chr(ord(c) - unicodedata.decimal(c) + draw.below(10)))
        else:
            out.append(c)
    if not any(c.isalpha() or c.isdecimal() for c in text):
        more = max(more, 4)
    letters = "0123456789" if text.isdecimal() else "0123456789abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
    return "".join(out) + "".join(letters[draw.below(len(letters))] for _ in range(more))


def _script(name: str) -> str:
    for c in name:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The surrogate key of an entity key."""
    draw, more = _Draw(key, kind, entity, attempt), attempt // STEP
    if kind.startswith("given") or kind == "surname":
        syllables, endings = _SCRIPTS[_script(entity)]
        end = endings["s" if kind == "surname" else kind[-1]]
        size = 2 + draw.below(2) + attempt // 4
        return "".join(syllables[draw.below(len(syllables))] for _ in range(size)) + end[draw.below(len(end))]
    if kind == "initial":       # rendered as its first letter, which is another one
        while True:
            out = "".join(syl[draw.below(len(syl))] for syl in [_SCRIPTS[_script(entity)][0]] * (3 + attempt // 4))
            if unicodedata.normalize("NFD", out[0])[0] != unicodedata.normalize("NFD", entity[0])[0]:
                return out
    if kind == "email":
        name, _, domain = entity.partition("@")
        body, _, top = domain.rpartition(".")
        return f"{_alike(name, draw, more)}@{_alike(body, draw) if any(map(str.isalnum, body)) else body}.{top}"
    if kind == "ip":
        if more:                # of the block for documentation
            return "2001:db8::" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(min(more + 1, 6)))
        return ".".join(str(1 + draw.below(254) if not i else draw.below(256)) for i in range(4))
    if kind == "card":
        out = _alike(entity, draw, more)
        if _luhn(entity) % 10 == 0:         # a valid number stays valid
            out = out[:-1] + str(-_luhn(out[:-1] + "0") % 10)
        return out
    if kind == "phone":
        # what makes the digits a phone in their format stays: the first of nine
        # from 6 on; a number of ten begins with 2 or more
        kept = entity[:1] if len(entity) == 9 and entity[0] in "6789" else ""
        first = kept or (str(2 + draw.below(8)) if len(entity) == 10 else str(1 + draw.below(9)))
        return first + _alike("0" * (len(entity) - 1), draw, more)
    if kind == "iban":
        body = _alike(entity[4:], draw, more).upper()
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    return _alike(entity, draw, more)


def render(mention: str, kind: str, chosen: str, entity: str) -> str:
    """The surrogate of an entity written as the mention is."""
    if kind in ("card", "ssn", "phone"):
        digits, out = list(chosen[:len(entity)]), []
        for c in reversed(mention):
            out.append(digits.pop() if c in "0123456789" and digits else c)
        return "".join(reversed(out)) + chosen[len(entity):]
    if kind == "iban":
        chars = iter(chosen)
        return "".join([c if c == " " else next(chars) for c in mention]) + "".join(chars)
    if kind == "email":
        return chosen.upper() if mention.isupper() else chosen
    if kind == "initial":
        return chosen[0].upper()
    if kind.startswith("given") or kind == "surname":
        return chosen.upper() if mention.isupper() else chosen.title()
    return chosen


# --- the table of entities --------------------------------------------------------

def _may_have(text: Column) -> Column:
    """What every text with an entity has: a digit, an at sign, a quote after a
    sign or a title."""
    out = text.rlike("[0-9@]|[:=]\\s*[\"']")
    for title in _GENDER:
        if not any(other != title and other in title for other in _GENDER):
            out = out | text.contains(title)
    return out


def _entities(text: Column) -> Column:
    @arrow_udf("array<struct<kind: string, entity: string>>")
    def run(texts: pa.Array) -> pa.Array:
        keep_caches()
        rows = [sorted({(kind, entity) for _, _, kind, entity in find(t)}) if t else [] for t in texts.to_pylist()]
        return pa.array([[{"kind": k, "entity": e} for k, e in row] for row in rows],
                        pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string())])))
    return run(text)


def _surrogates(kind: Column, entity: Column, attempt: Column, key: bytes) -> Column:
    @arrow_udf("string")
    def run(kinds: pa.Array, entities: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, k, e, a) for k, e, a in
                         zip(kinds.to_pylist(), entities.to_pylist(), attempts.to_pylist())], pa.string())
    return run(kind, entity, attempt)


def _family(kind: Column) -> Column:
    """Kinds whose values must differ from each other: all given names are one."""
    return F.when(kind.startswith("given"), F.lit("given")).otherwise(kind)


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity), surrogates distinct
    within a family of kinds and none an entity of that family."""
    real = materialize(entities.select("kind", "entity", _family(F.col("kind")).alias("family")).distinct(), "entities")
    known = real.select("family", F.col("entity").alias("surrogate")).distinct()
    pending = real.withColumn("attempt", F.lit(0))
    done = None
    while True:
        drawn = materialize(pending.withColumn(
            "surrogate", _surrogates(F.col("kind"), F.col("entity"), F.col("attempt"), key)), "drawn")
        # one row per drawn value: who gets it
        winner = drawn.filter("surrogate != entity").groupBy("family", "surrogate").agg(
            F.min(F.struct("kind", "entity")).alias("winner"))
        if done is not None:
            winner = winner.join(done.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        clash = known.withColumn("real", F.lit(True))
        winner = winner.join(clash, ["family", "surrogate"], "left")
        judged = materialize(drawn.join(winner, ["family", "surrogate"], "left").withColumn("ok", F.coalesce(
            (F.col("winner.kind") == F.col("kind")) & (F.col("winner.entity") == F.col("entity"))
            & F.col("real").isNull(), F.lit(False))), "judged")
        good = judged.filter("ok").select("family", "kind", "entity", "surrogate")
        done = good if done is None else done.unionByName(good)
        pending = judged.filter("not ok").select("kind", "entity", "family", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done.select("kind", "entity", "surrogate")


def _rewrite(text: Column, table: Column) -> Column:
    """Struct of the new text and its entities, from a text and its part of the table."""
    kind = "struct<text: string, entities: array<struct<kind: string, start: int, end: int>>>"

    @arrow_udf(kind)
    def run(texts: pa.Array, tables: pa.Array) -> pa.Array:
        keep_caches()
        out = []
        for value, rows in zip(texts.to_pylist(), tables.to_pylist()):
            chosen = {(r["kind"], r["entity"]): r["surrogate"] for r in rows or []}
            parts, spans, at, size = [], [], 0, 0
            for start, end, what, entity in find(value) if chosen else []:
                if start < at:
                    continue
                new = render(value[start:end], what, chosen[what, entity], entity)
                size += start - at
                parts += [value[at:start], new]
                spans.append({"kind": what, "start": size, "end": size + len(new)})
                size += len(new)
                at = end
            out.append({"text": None if value is None else "".join(parts) + value[at:], "entities": spans})
        return pa.array(out, pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]))
    return run(text, table)


def surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Replace entities in ``text_col`` and add ``entities`` (kind, start and end
    in the new text).

    Null and empty texts and texts without entities stay as they are, with no
    entities.  Replacement depends on the text and the corpus's entities alone:
    repeated rows get the same text, ids play no part.  An empty table gives an
    empty result.  A column named entities is replaced, all others stay (names
    that begin with ``__`` are used in between).
    """
    secret, columns, text = key.encode(), others(docs, ["entities"]), F.col(text_col)
    may = F.coalesce(_may_have(text), F.lit(False))
    digest = F.sha2(text.cast("binary"), 256)
    found = materialize(docs.filter(may).select(digest.alias("__digest"), _entities(text).alias("found"))
                        .filter(F.size("found") > 0).groupBy("__digest").agg(F.first("found").alias("found")), "found")
    each = found.select("__digest", F.explode("found").alias("e")).select("__digest", "e.kind", "e.entity")
    table = materialize(assign(each.select("kind", "entity"), secret), "surrogates")
    by_text = each.join(table, ["kind", "entity"]).groupBy("__digest").agg(
        F.collect_list(F.struct("kind", "entity", "surrogate")).alias("__table"))
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    changed = (docs.filter(may).withColumn("__digest", digest).join(by_text, "__digest", "left")
               .withColumn("__new", _rewrite(text, F.col("__table")))
               .select(*[F.col("__new.text").alias(c) if c == text_col else F.col(c) for c in columns],
                       F.col("__new.entities").alias("entities")))
    return docs.filter(~may).select(*columns, none.alias("entities")).unionByName(changed)
