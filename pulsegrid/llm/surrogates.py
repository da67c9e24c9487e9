"""PII: detected entities are replaced by keyed surrogates of the same type and format, distinct where the entities are."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import keyed_text, materialise, slices

#: Attempts before the collision check gives up (each leaves a vanishing share of the entities before it).
MOST_ATTEMPTS = 64

#: Titles by gender, and given names by script and gender, from which names are drawn.
_TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Dr": "n", "Prof": "n", "г-н": "m", "г-жа": "f", "κ": "m", "κα": "f"}
_TITLES |= {t.upper(): g for t, g in _TITLES.items() if t.isascii()}
_GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Karl Leo Martin Nils Oscar Paul Robert Simon Tobias Victor".split(),
    ("latin", "f"): "Alice Berta Clara Diana Emma Fiona Greta Helen Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sara Teresa Vera".split(),
    ("latin", "n"): "Alex Billie Charlie Dana Eden Frankie Gale Harper Indigo Jamie Kim Logan Morgan Noel Onyx Pat Quinn Robin Sam Taylor".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей Тимур Фёдор Юрий".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Зоя Ирина Клара Лариса Мария Нина Ольга Полина Раиса София Тамара Юлия".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σπύρος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Λένα Μαρία Νίκη Ρένα Σοφία".split(),
}
#: Letters of other scripts, from the first to the last of a range without gaps.
_LETTERS = (("\u4e00", "\u9fa5"), ("\u3042", "\u3093"), ("\u30a2", "\u30f3"), ("\uac00", "\ud7a3"), ("\u0627", "\u064a"), ("\u05d0", "\u05ea"), ("\u0905", "\u0939"), ("\u0e01", "\u0e2e"), ("\u10d0", "\u10f0"), ("\u0561", "\u0586"), ("\u0531", "\u0556"))
_SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga gi ha he ka ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve wa we".split(),
    "cyrillic": "ба ве го да жи за ко ла ме ни по ра се то фи ха ца ша".split(),
    "greek": "βα γε δο ζη θα κο λα με νι ξα πο ρα σε το φι χα".split(),
}

#: Types in the order in which they claim text; each has the characters one of which every match has.
#: Letters of addresses; those of a name's first and further words: a capital of any script, parts joined by - and ', and before them
#: initials and the particles of surnames (fixed values).
_MAIL = "A-Za-z0-9\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff"
_WORD_OF_NAME = r"[^\W\d_a-zа-яα-ω](?:[^\W\d_]+(?:['’-][^\W\d_]+)*|(?:['’-][^\W\d_]+)+)"
_PARTICLES = "al bin da de del della den der di dos du el ibn la le ten ter van von zu"
_BEFORE = rf"(?:(?:[^\W\d_a-zа-яα-ω]\.|{'|'.join(_PARTICLES.split())}) )*"
_NAME = "|".join(sorted(map(re.escape, _TITLES), key=len, reverse=True))
DETECTORS: tuple[tuple[str, str, re.Pattern], ...] = (
    ("private_key", "-", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----")),
    ("secret", "@", re.compile(r"://[^\s/:@\0]{1,64}:(?P<v>[^\s/@\0]{3,})@")),
    ("email", "@", re.compile(rf"[{_MAIL}](?:[{_MAIL}._%+-]{{0,63}})@(?:[{_MAIL}](?:[{_MAIL}-]{{0,61}}[{_MAIL}])?\.)+[{_MAIL}]{{2,24}}\b")),
    ("access_key", "_-AG", re.compile(r"\b(?:AKIA|ASIA)(?P<v>[0-9A-Z]{16})\b|\b(?:gh[pousr]_|sk-|xox[bp]-)(?P<w>[A-Za-z0-9-]{16,})")),
    ("secret", "=:", re.compile(
        r"(?i)(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,24}[_-]){0,4}(?:password|passwd|pwd|secret|token|api[_-]?key)(?:[_-][A-Za-z0-9]{1,24}){0,4}[\"']?\s{0,2}[=:]\s{0,2}"
        r"(?:\"(?P<v>[^\"\n\0]{6,200})\"|'(?P<w>[^'\n\0]{6,200})'|[\"']?(?P<x>[^\s\"',;<>\0]{6,}))"
    )),
    ("secret", " ", re.compile(r"(?i)\bbearer {1,2}(?P<v>[A-Za-z0-9._~+/=-]{16,})")),
    ("iban", "", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    ("ip", ".", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("ipv6", ":", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")),
    ("phone", "+(-. ", re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("phone", "+", re.compile(r"(?<![0-9A-Za-z+])\+[1-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![0-9])")),
    ("national_id", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("card", "", re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])")),
    ("name", "", re.compile(rf"(?<!\w)(?P<t>{_NAME})\.? (?:(?:{_NAME})\.? )*(?!(?:{_NAME})\b)(?P<v>{_BEFORE}{_WORD_OF_NAME}(?: {_BEFORE}{_WORD_OF_NAME}){{0,4}})")),
)
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\w+")
_TITLE = re.compile(rf"(?<!\w)(?:{_NAME})\.? ")
#: Types of any length. Their surrogates, emails and names grow by a character or syllable each GROW attempts, so any number of them gets distinct ones.
_FREE, GROW = {"secret", "access_key", "private_key"}, 4
#: What stands for letters of scripts not named here, and for all characters of a value with fewer than LEAST_DRAWN that can be replaced by their like.
_ALPHABET, LEAST_DRAWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 6
_NEEDS_DIGIT = {"iban", "ip", "ipv6", "phone", "national_id", "card"}
#: Attempts from which an address may lie anywhere in its range, and any value is a typed token.
ANYWHERE, TOKEN = 8, 24
#: Address ranges that don't belong to the open net, by their first octets.
_PRIVATE = ((10,), (127,), (192, 168), (169, 254), *((172, x) for x in range(16, 32)))


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order and without overlap; earlier types go first.

    A name that stands after a title somewhere in the text is found where it stands without one too: in full, or its last word.
    """
    if not text:
        return []
    digit, found, whole = _DIGIT.search(text) is not None, [], text
    for kind, signs, pattern in DETECTORS:
        if kind in _NEEDS_DIGIT and not digit or signs and not any(c in text for c in signs) or kind == "name" and not _TITLE.search(text):
            continue
        own = []
        for m in pattern.finditer(text):
            groups = m.groupdict()
            g = next((k for k in ("v", "w", "x") if groups.get(k) is not None), 0)
            if not _VALID.get(kind, bool)(m[0]) or kind in _FREE and _masked(kind, m[g]):
                continue
            own.append((*m.span(g), f"name_{_TITLES[m['t']]}" if kind == "name" else kind))
        if own:  # what one type has claimed, the next ones don't see
            found += own
            at, parts = 0, []
            for s, e, _ in own:
                parts += [text[at:s], "\0" * (e - s)]
                at = e
            text = "".join([*parts, text[at:]])
            if kind == "name":
                found += _untitled(text, {whole[s:e]: k for s, e, k in own})
    return sorted(found)


def _untitled(text: str, named: dict[str, str]) -> list[tuple[int, int, str]]:
    """The mentions without a title, in a text that the named ones are cut out of."""
    kinds = {name.rpartition(" ")[2]: "name_n" for name in named} | named
    starts: dict[str, set[int]] = {}
    for name in kinds:
        starts.setdefault(_WORD.match(name)[0], set()).add(len(name))
    sizes = {word: sorted(own, reverse=True) for word, own in starts.items()}
    out, after = [], 0
    for m in _WORD.finditer(text):  # each word looks up the names that begin with it, the longest first
        s = m.start()
        for size in sizes.get(m[0], ()) if s >= after else ():
            kind = kinds.get(text[s : s + size])
            if kind and not _WORD.match(text, s + size):
                out.append((s, s + size, kind))
                after = s + size
                break
    return out


def _masked(kind: str, value: str) -> bool:
    """A placeholder (one sign repeated, a key block without a letter or digit), which is no entity."""
    if kind == "private_key":
        return not any(c.isalnum() for c in _key_body(value)[1])
    return not value[0].isalnum() and len(set(value)) == 1


def _key_body(value: str) -> tuple[str, str, str]:
    head, tail = value.index("KEY-----") + 8, value.rindex("-----END")
    return value[:head], value[head:tail], value[tail:]


def canonical(kind: str, mention: str) -> str:
    """What all mentions of an entity share: letter case of emails and names, and separators of numbers, don't tell entities apart.

    A phone number is its digits with + and country code, or without both where it is a North American one.
    """
    if kind == "email" or kind.startswith("name_"):
        return mention.lower()
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(mention))
    if kind in ("phone", "card", "national_id"):
        digits = "".join(_DIGIT.findall(mention))
        if kind != "phone" or "+" not in mention:
            return digits
        return digits[1:] if digits[0] == "1" and len(digits) == 11 else "+" + digits
    return mention.replace(" ", "") if kind == "iban" else mention


def entities_of(kind: str, mention: str) -> list[tuple[str, str]]:
    """(type, canonical form) of what a mention names. A full name is its last word, which all of its mentions share, and what stands before that word."""
    canon = canonical(kind, mention)
    if not kind.startswith("name_"):
        return [(kind, canon)]
    last = [("surname", canon.rpartition(" ")[2])]
    return last if " " not in canon else [*last, (f"given_{kind[-1]}", canon)]


class _Stream:
    """Numbers below given bounds, by the key, type, entity and attempt alone."""

    def __init__(self, *seed: str | int, key: bytes):
        self.key, self.seed, self.block, self.pool, self.size = key, "\x1f".join(map(str, seed)).encode("utf-8", "replace"), 0, 0, 1

    def below(self, n: int) -> int:
        while self.size < n << 32:
            more = hashlib.blake2b(self.seed + self.block.to_bytes(4, "little"), key=self.key, digest_size=64).digest()
            self.pool, self.size, self.block = self.pool << 512 | int.from_bytes(more, "little"), self.size << 512, self.block + 1
        self.pool, out = divmod(self.pool, n)
        self.size //= n
        return out


def _luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _iban_mod(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban_valid(mention: str) -> bool:
    s = mention.replace(" ", "")
    return 15 <= len(s) <= 34 and _iban_mod(s) == 1


def _ipv6_valid(mention: str) -> bool:
    """An address; a short one needs a digit and a group of three, so that words of code are none."""
    try:
        ipaddress.IPv6Address(mention)
    except ValueError:
        return False
    return "::" not in mention or _DIGIT.search(mention) is not None and any(len(x) > 2 for x in mention.split(":"))


_VALID = {"iban": _iban_valid, "ipv6": _ipv6_valid, "phone": lambda m: not re.fullmatch(r"\+[0-9]+\.[0-9]+", m), "card": lambda m: _luhn("".join(_DIGIT.findall(m))) == 0}

#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = {*map(str, (20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98))}


def _same_kind(c: str, draw: _Stream, hexadecimal: bool = False) -> str:
    if c.isascii() and c.isdigit():
        return "0123456789"[draw.below(10)]
    if hexadecimal and c in "abcdefABCDEF":
        return ("abcdef" if c.islower() else "ABCDEF")[draw.below(6)]
    for low, n in (("a", 26), ("A", 26), ("а", 32), ("А", 32), ("α", 17), ("Α", 17)):
        if low <= c < chr(ord(low) + n):
            return chr(ord(low) + draw.below(n))
    for low, high in _LETTERS:
        if low <= c <= high:
            return chr(ord(low) + draw.below(ord(high) - ord(low) + 1))
    return c if c.isascii() or not c.isalnum() else _ALPHABET[draw.below(len(_ALPHABET))]


def _free_form(value: str, attempt: int, draw: _Stream) -> str:
    """Each letter and digit by its like; every character where too few of them tell values apart."""
    if sum(c.isalnum() for c in value) < LEAST_DRAWN:
        out = "".join(c if c.isspace() else _ALPHABET[draw.below(len(_ALPHABET))] for c in value)
    else:
        hexadecimal = re.fullmatch("[0-9a-fA-F]+", value) is not None
        out = "".join(_same_kind(c, draw, hexadecimal) for c in value)
    return out + "".join(_ALPHABET[draw.below(len(_ALPHABET))] for _ in range(attempt // GROW))


def script_of(word: str) -> str | None:
    """The script whose syllables make up names; None for the scripts of _LETTERS, whose names are drawn letter by letter."""
    if re.search("[Ѐ-ӿ]", word):
        return "cyrillic"
    if re.search("[Ͱ-Ͽ]", word):
        return "greek"
    return None if any(low <= c <= high for c in word for low, high in _LETTERS) else "latin"


def family(kind: str) -> str:
    """The type within which entities and surrogates are told apart: given names of all genders are one."""
    return "given" if kind.startswith("given_") else kind


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of a canonical entity: never the entity itself, of the same type, length and format.

    From attempt TOKEN on, or where the format leaves no other value, it is a token of the type.
    """
    if attempt < TOKEN:
        for turn in range(100):
            out = _draw(kind, entity, attempt, _Stream(family(kind), entity, attempt, turn, key=key))
            if out != entity:
                return out
    draw = _Stream("token", family(kind), entity, attempt, key=key)
    token = "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] for _ in range(12))
    return f"{token} {entity.rpartition(' ')[2]}" if kind.startswith("given_") else token if kind == "surname" else f"<{kind}-{token}>"


def _octets(entity: str, attempt: int, draw: _Stream) -> str:
    """Another address of the same range, and with as many digits in each place while attempts are few."""
    old = tuple(map(int, entity.split(".")))
    kept = next((p for p in _PRIVATE if old[: len(p)] == p), ())
    new = list(kept)
    for x in old[len(kept) :]:
        low, high = {1: (1, 9), 2: (10, 99), 3: (100, 255)}[len(str(x))] if attempt < ANYWHERE else (1, 254)
        new.append(low + draw.below(high - low + 1))
    return ".".join(map(str, new))


def _name_part(word: str, attempt: int, draw: _Stream) -> str:
    script = script_of(word)
    if script is None:
        return "".join(_same_kind(c, draw) for c in word + word[-1] * (attempt // GROW))
    return "".join(_SYLLABLES[script][draw.below(len(_SYLLABLES[script]))] for _ in range(3 + attempt // GROW))


def _draw(kind: str, entity: str, attempt: int, draw: _Stream) -> str:
    if kind == "email":
        local, _, domain = entity.partition("@")
        name, _, top = domain.rpartition(".")
        more = "".join(_ALPHABET[draw.below(len(_ALPHABET))] for _ in range(attempt // GROW)).lower()
        return "".join(_same_kind(c, draw) for c in local).lower() + more + "@" + "".join(_same_kind(c, draw) for c in name).lower() + "." + top
    if kind == "ip":
        return _octets(entity, attempt, draw)
    if kind == "ipv6":
        first = entity.partition(":")[0]
        kept = [first] if re.match("f[cdf]|fe[89ab]", first) else []  # local and multicast addresses stay such
        return ":".join([*kept, *(f"{0x1000 + draw.below(0xF000):x}" for _ in range(8 - len(kept)))])
    if kind == "phone" and entity[0] == "+":
        code = 1 + (1 if entity[1] in "17" else 2 if entity[1:3] in _TWO_DIGITS else 3)
        return entity[:code] + "".join(_same_kind(c, draw) for c in entity[code:])
    if kind == "card":
        body = entity[0] + "".join(_same_kind(c, draw) for c in entity[1:-1])
        return body + str(-_luhn(body + "0") % 10)
    if kind == "phone":
        return str(2 + draw.below(8)) + "".join(_same_kind(c, draw) for c in entity[1:])
    if kind == "iban":
        body = "".join(_same_kind(c, draw) for c in entity[4:])
        return f"{entity[:2]}{98 - _iban_mod(entity[:2] + '00' + body):02d}{body}"
    if kind in ("secret", "access_key"):
        return _free_form(entity, attempt, draw)
    if kind == "surname":
        return _name_part(entity, attempt, draw)
    if kind.startswith("given_"):
        first, _, last = entity.rpartition(" ")
        script = script_of(first)
        pool = _GIVEN.get((script, kind[-1])) or [*_GIVEN.get((script, "m"), ()), *_GIVEN.get((script, "f"), ())]
        given = pool[draw.below(len(pool))].lower() if pool and attempt < GROW else _name_part(first, attempt - GROW if pool else attempt, draw)
        return f"{given} {last}"
    if kind == "private_key":
        head, body, tail = _key_body(entity)
        return head + _free_form(body, attempt, draw) + tail
    return "".join(_same_kind(c, draw) for c in entity)


def written_as(kind: str, mention: str, canon: str) -> str:
    """The canonical surrogate in the mention's layout: its separators, country code and letter case."""
    if canon.startswith(f"<{kind}-"):
        return canon
    if kind == "email":
        return canon.upper() if mention.isupper() else canon
    if kind.startswith("name_"):
        return canon.upper() if mention.isupper() and len(mention) > 1 else " ".join(w[:1].upper() + w[1:] for w in canon.split(" "))
    if kind in ("phone", "card", "national_id", "iban"):
        marks, canon = list(mention), canon.lstrip("+")
        at = [i for i, c in enumerate(marks) if (c.isalnum() if kind == "iban" else c.isdigit())][-len(canon) :]
        for i, c in zip(at, canon, strict=True):
            marks[i] = c
        return "".join(marks)
    return canon


def replace(text: str | None, key: bytes, attempts: dict[tuple[str, str], tuple[str, int]] | None = None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with every entity replaced, and the entities' spans in the given text. `attempts` has the type and attempt to draw by, where not the first of its own."""
    found = detect(text)
    if not found:
        return text, found
    out, at = [], 0
    for s, e, kind in found:
        mention, drawn = text[s:e], []
        for of, canon in entities_of(kind, mention):
            as_kind, attempt = (attempts or {}).get((of, canon), (of, 0))
            drawn.append(surrogate(as_kind, canon, attempt, key))
        canon = drawn[0] if len(drawn) == 1 else f"{drawn[1].rpartition(' ')[0]} {drawn[0]}"
        out += [text[at:s], written_as(kind, mention, canon)]
        at = e
    return "".join([*out, text[at:]]), found


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, th, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
            text = x.as_py()
            rows += [(doc_id, th, *k) for k in dict.fromkeys(x for s, e, kind in detect(text) for x in entities_of(kind, text[s:e]))]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "th", "kind", "canon"])


def _surrogate_column(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            out = [surrogate(*r, key) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["kind", "canon", "attempt", "canon_surrogate"])

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, as_kind, attempt) of those distinct entities (kind, canon) whose first surrogate won't do.

    An entity draws anew while another (of the same family, earlier by attempt and name) has its
    surrogate, or while its surrogate is itself an entity of the input; the check runs over all entities.
    A full name without a gendered title is drawn as after the gendered title of its other mentions, if they have one gender.
    """
    gendered = entities.where("kind IN ('given_m', 'given_f')").groupBy("canon").agg(F.min("kind").alias("g1"), F.max("kind").alias("g2")).where("g1 = g2").select("canon", F.lit("given_n").alias("kind"), "g1")
    drawn_as = materialise(entities.join(gendered, ["kind", "canon"], "left").select("kind", "canon", F.coalesce("g1", "kind").alias("as_kind")), "drawn-as")
    current = drawn_as.select(F.col("as_kind").alias("kind"), "canon").distinct().withColumn("attempt", F.lit(0))
    fam = F.when(F.col("kind").startswith("given_"), F.lit("given")).otherwise(F.col("kind")).alias("family")
    for turn in range(MOST_ATTEMPTS):
        drawn = current.mapInArrow(_surrogate_column(key), "kind string, canon string, attempt int, canon_surrogate string")
        drawn = materialise(drawn.select("*", fam), f"drawn{turn}")
        # A family keeps one of those that share a surrogate: the one settled longest ago.
        first = drawn.groupBy("family", "canon_surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        clash = drawn.join(first, ["family", "canon_surrogate"]).where("canon <> first.canon").select("kind", "canon")
        real = drawn.join(entities.select(fam, F.col("canon").alias("canon_surrogate")), ["family", "canon_surrogate"], "left_semi").select("kind", "canon")
        again = materialise(clash.unionByName(real).distinct(), f"clash{turn}")
        if again.isEmpty():
            settled = drawn.select(F.col("kind").alias("as_kind"), "canon", "attempt")
            return drawn_as.join(settled, ["as_kind", "canon"]).where("attempt > 0 OR as_kind <> kind").select("kind", "canon", "as_kind", "attempt")
        current = drawn.join(again.withColumn("again", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError(f"entities still share surrogates after {MOST_ATTEMPTS} attempts")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs (doc_id, text and others) with each text's entities replaced; n_entities is added.

    An entity has the same surrogate in all texts (what stands before a surname has one for each gender its titles give it, and a surname one
    in all names), two entities never share one, and none is an entity of the input. Texts without entities are unchanged, null and empty ones too; repeated rows
    are changed alike; a column n_entities of docs is replaced. A first surrogate needs the key alone; only the rare entities that had to draw
    again are looked up, by a join of their documents (kept small enough to broadcast by Spark's own size check or else shuffled).
    """
    docs = docs.drop("n_entities")
    mentions = materialise(keyed_text(docs).select("doc_id", "text", "th").mapInArrow(_mentions, "doc_id long, th long, kind string, canon string"), "mentions")
    redrawn = materialise(assign(mentions.select("kind", "canon").distinct(), key), "redrawn")
    by_doc = mentions.join(redrawn, ["kind", "canon"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "canon", "as_kind", "attempt")).alias("again"))
    by_doc = materialise(by_doc, "redrawn-docs")
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(by_doc["doc_id"]) & (F.xxhash64("doc.text") == by_doc["th"])
    names = list(docs.columns)
    at, extra = names.index("text"), "again" + "_" * sum(map(len, names))  # a name that no column has
    joined = rows.join(by_doc, same, "left").select("doc.*", F.col("again").alias(extra))
    schema = docs.select("*", F.lit(0).cast("long").alias("n_entities")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 4 << 20):
            texts, counts = [], []
            for x, again in zip(batch.column(at), batch.column(len(names)), strict=True):
                redo = {(r["kind"], r["canon"]): (r["as_kind"], r["attempt"]) for r in again.as_py() or ()} if again.is_valid else None
                text, found = replace(x.as_py(), key, redo)
                texts.append(text)
                counts.append(len(found))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, "n_entities"])

    return joined.mapInArrow(run, schema)


#: The key of the registered query; a real run passes a secret of its own.
DEMO_KEY = b"pulsegrid demonstration key"


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, DEMO_KEY).select("doc_id", "n_entities", "text")
