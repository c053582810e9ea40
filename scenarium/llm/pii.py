"""Surrogates for personal data: keyed, format-preserving, distinct and coreferent."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.llm.textarrays import slices
from scenarium.plans.materialize import materialize

#: Replace this by a secret of your own: surrogates can be undone by whoever has the key.
DEFAULT_KEY = b"scenarium surrogate key"
ROUNDS = 8
#: Characters that are searched for names at once.
PART = 1 << 16
#: So often a surrogate is drawn; what still clashes is in a format that is nearly full and is permuted among itself.
MAX_ATTEMPTS = 32

# Given names by (script, gender), surnames by script.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Claire Elena Carmen Lucia Camille Hannah Sarah Emily Jane Mary Linda Susan Karen Nancy Fatima Aisha Priya Mei Yuki Sofia Isabella Olivia Ingrid Astrid Giulia Chiara Francesca Ana Beatriz Zofia Katarzyna Ewa Amina Leila Patricia Jennifer Barbara Elizabeth".split(),
    ("latin", "m"): "John James Robert Michael William David Richard Thomas Hans Peter Klaus Juan Carlos Pedro Miguel Pierre Louis Jacques Paul George Mohammed Ahmed Ali Omar Raj Amit Wei Kenji Hiroshi Lars Erik Giovanni Marco Luca Piotr Tomasz Andrzej Diego Luis Jose Daniel Andrew Kevin Brian Steven Joseph Charles Christopher Matthew Anthony Mark Ibrahim".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Екатерина".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел".split(),
}
SURNAMES = {
    "latin": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Schmidt Schneider Fischer Weber Meyer Garcia Martinez Lopez Gonzalez Dupont Martin Bernard Durand Moreau".split(),
    "cyrillic": "Иваненко Петренко Шевченко Бондаренко Ткаченко Кравченко Коваленко Лысенко".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Dr": "", "Prof": ""}
_GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_SCRIPT = {name: script for script, names in SURNAMES.items() for name in names}

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_LETTER = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_HEX = "0123456789abcdef"


@lru_cache
def _like(page: int, category: str) -> str:
    """The characters of one category among 256 neighbours, for scripts without an alphabet of their own."""
    return "".join(c for c in map(chr, range(page << 8, (page + 1) << 8)) if unicodedata.category(c) == category)


def _place(c: str) -> tuple[str, int] | None:
    """The alphabet in which a character is permuted, and its place there; none if it stays."""
    found = _LETTER.get(c.lower() if len(c.lower()) == 1 else c)
    if found or ord(c) < 128 or not c.isalnum():
        return found
    alphabet = _like(ord(c) >> 8, unicodedata.category(c))
    return (alphabet, alphabet.index(c)) if len(alphabet) > 1 else None


def _movable(value: str) -> bool:
    return any(_place(c) for c in value)


def permute(symbols: list[int], radix: list[int], tweak: bytes, key: bytes) -> list[int]:
    """A keyed permutation of mixed-radix sequences: alternating Feistel rounds between two halves."""
    half = len(symbols) // 2
    out = list(symbols)
    for n in range(ROUNDS):
        changed, other = (range(half, len(out)), out[:half]) if n % 2 == 0 else (range(half), out[half:])
        seed = hashlib.blake2b(b"%d|%s|" % (n, tweak) + ",".join(map(str, other)).encode(), key=key[:64]).digest()
        stream = b"".join(hashlib.blake2b(b"%d|" % block + seed, key=key[:64]).digest() for block in range(-(-len(changed) // 32)))
        for k, i in enumerate(changed):
            out[i] = (out[i] + int.from_bytes(stream[2 * k : 2 * k + 2])) % radix[i]
    return out


def _text(value: str, kind: str, attempt: int, key: bytes, hexadecimal: bool = False) -> str:
    """Letters and digits of a value are permuted within their script and case; all else stays."""
    places, symbols, alphabets = [], [], []
    for i, c in enumerate(value):
        if hexadecimal and c in _HEX:
            found = (_HEX, _HEX.index(c))
        else:
            found = _place(c)
        if found:
            places.append(i)
            alphabets.append(found[0])
            symbols.append(found[1])
    shape = "".join(a[0] for a in alphabets)
    moved = permute(symbols, [len(a) for a in alphabets], f"{kind}|{shape}|{attempt}".encode(), key)
    out = list(value)
    for i, a, s in zip(places, alphabets, moved, strict=True):
        out[i] = a[s].upper() if a in _ALPHABETS and value[i] != value[i].lower() else a[s]
    return "".join(out)


def _digits(value: str, kept: int, kind: str, attempt: int, key: bytes, good: Callable[[str], bool] = lambda _: True) -> str:
    """All digits but the first ``kept`` are permuted, again until the number is as ``good`` as before."""
    own = [int(c) for c in value if c.isdigit()]
    head, tail = own[:kept], own[kept:]
    tweak = f"{kind}|{head if kind == 'card' else ''}|{len(tail)}|{attempt}".encode()
    was = good("".join(map(str, own)))
    while True:
        tail = permute(tail, [10] * len(tail), tweak, key)
        if good("".join(map(str, head + tail))) == was:
            break
    new = iter(head + tail)
    return "".join(str(next(new)) if c.isdigit() else c for c in value)


def _special(octets: list[int]) -> int:
    """How many leading octets make an address private, local or loopback; 0 for others."""
    a, b = octets[:2]
    return 1 if a in (10, 127) else 2 if (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b < 32) else 0


def _address(value: str, attempt: int, key: bytes) -> str:
    """Private addresses stay within their range, public ones public."""
    octets = [int(x) for x in value.split(".")]
    kept = _special(octets)
    head, tail = octets[:kept], octets[kept:]
    while True:
        tail = permute(tail, [256] * len(tail), f"ipv4|{head}|{attempt}".encode(), key)
        if kept or not _special(tail):
            return ".".join(map(str, head + tail))


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def _from_list(name: str, names: list[str], tweak: str, key: bytes) -> str:
    order = sorted(names, key=lambda x: hashlib.blake2b(f"{tweak}|{x}".encode(), key=key[:64]).digest())
    return order[(order.index(name) + 1) % len(order)]  # one cycle: nobody keeps their name


@dataclass
class Kind:
    """How one kind of entity is found, what makes two mentions the same, and what replaces it."""

    name: str
    pattern: re.Pattern[str]
    hint: Callable[[str], bool]
    group: int = 0
    valid: Callable[[str], bool] = lambda _: True
    same: Callable[[str], str] = lambda v: v


def _has_digit(text: str) -> bool:
    return _DIGIT.search(text) is not None


_DIGIT = re.compile("[0-9]")
_SEPARATED = re.compile("[0-9](?:[0-9]{6}|[ .)-][ .(-]?[0-9])")
_only_digits = lambda v: "".join(c for c in v if c.isdigit())
#: A capitalised word, also of two joined ones.
_CAPITAL = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİŁĶĽŃŇŌŐŒŘŚŞŠŤŪŮŰŲŹŻŽА-ЯЁЄІЇҐ"
_SURNAME = f"(?:[^\\W\\d_]{{1,3}}['’])?[{_CAPITAL}][^\\W\\d_]+(?:[-'’][^\\W\\d_]+)*"
_GIVENS, _TITLES = ("(?:" + "|".join(names) + ")" for names in (_GENDER, TITLES))
#: After these and a colon or comma, two or three capitalised words are a person, whatever the names.
_CUES = "Name|Full name|Author|Contact|Contact person|Signed|Signed by|Sincerely|Yours truly|Best regards|Kind regards|Regards|Attn|Nom|Kontakt|Nombre"
#: A cue holds one of these.
_CUE_PARTS = ("ame", "Author", "ontact", "igned", "Sincerely", "egards", "truly", "Attn", "Nom", "Kontakt")
_CAPITALS = re.compile(f"[{_CAPITAL}][^\\W\\d_]+")
_NAMES = {*_GENDER, *TITLES}


def _names(text: str) -> bool:
    """Whether a given name or a title is one of the capitalised words."""
    # some text at a time, so that a very long one makes no long list; a name that is cut is whole in the next part
    return any(not _NAMES.isdisjoint(_CAPITALS.findall(text, at, at + PART + 64)) for at in range(0, len(text), PART))


def _cues(text: str) -> bool:
    return any(part in text for part in _CUE_PARTS)


KINDS = [
    Kind("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), lambda t: "@" in t, valid=lambda v: _movable(v.rpartition(".")[0]), same=str.lower),
    Kind("aws_key", re.compile(r"\b(?:AKIA|ASIA)([0-9A-Z]{16})\b"), lambda t: "AKIA" in t or "ASIA" in t, 1),
    Kind("secret", re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{6,})", re.I), lambda t: "=" in t or ":" in t, 1, valid=_movable),
    Kind("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _has_digit, same=lambda v: v.replace(" ", "")),
    Kind("ipv4", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"), _has_digit, valid=lambda v: all(int(x) < 256 for x in v.split("."))),
    Kind("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{9,14}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-](?:\(\d{1,4}\)|\d{1,8})){2,6}(?!\w)|(?<![\w+.-])0\d(?:[ .-]\d{2}){4}(?![\w-])"), _has_digit, valid=lambda v: 6 <= len(_only_digits(v)) <= 18, same=lambda v: _only_digits(v)[-10:]),
    Kind("national_id", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _has_digit),
    Kind("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"), _has_digit, same=_only_digits),
    Kind("person", re.compile(rf"\b(?:{_CUES})\s*[:,]\s*({_SURNAME}(?:[ \t]+{_SURNAME}){{1,2}})(?!\w)"), _cues, 1, same=lambda v: " ".join(v.split())),
    Kind("person", re.compile(rf"\b(?:(?:{_TITLES}(?:\.\s*|\s+))+(?:{_GIVENS}\s+)*|(?:{_GIVENS}\s+)+)(?!{_TITLES}\b){_SURNAME}\b"), _names, same=lambda v: " ".join(v.replace(".", ". ").split())),
]
_BY_NAME = {k.name: k for k in KINDS}


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """What replaces ``value``. Distinct values of one kind and format have distinct surrogates."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_text(local, 'local', attempt, key)}@{_text(host, 'host', attempt, key)}.{top}"
    if kind == "ipv4":
        return _address(value, attempt, key)
    if kind == "phone":
        return _digits(value, max(0, len(_only_digits(value)) - 10), kind, attempt, key)
    if kind == "card":
        return _digits(value, 1, kind, attempt, key, luhn)
    if kind == "national_id":
        return _digits(value, 0, kind, attempt, key)
    if kind == "iban":
        return value[:2] + _text(value[2:], kind, attempt, key)
    if kind == "person":
        words = re.split(r"(\s+|\.)", value)
        last = max(i for i, w in enumerate(words) if i % 2 == 0 and w)
        return "".join(w if i % 2 or not w or (i < last and w in TITLES) else _name(w, i == last, attempt, key) for i, w in enumerate(words))
    return _text(value, kind, attempt, key, hexadecimal=all(c in _HEX for c in value))


def _name(word: str, last: bool, attempt: int, key: bytes) -> str:
    """Listed names go to the next of their list; others, and surnames drawn again, are permuted letter by letter, past the listed ones."""
    if word in _SCRIPT and (last or word not in _GENDER) and not attempt:
        return _from_list(word, SURNAMES[_SCRIPT[word]], "surname", key)
    if word in _GENDER and not (last and attempt):
        script, gender = _GENDER[word]
        return _from_list(word, GIVEN[script, gender], f"{script}{gender}", key)
    if not last:
        attempt = 0  # given names stay what they are drawn as
    while True:
        word = _text(word, "surname", attempt, key)
        if word not in _SCRIPT and word not in _GENDER:
            return word


def find(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), earlier kinds of KINDS first where they overlap."""
    found: list[tuple[int, int, str]] = []  # in order
    separated = _SEPARATED.search(text) is not None
    for kind in KINDS:
        if (kind.hint is _has_digit and not separated) or not kind.hint(text):
            continue
        begins, new = [a for a, _, _ in found], []
        for m in kind.pattern.finditer(text):  # these don't overlap each other
            a, b = m.span(kind.group)
            at = bisect_left(begins, b)  # the last that begins before b
            if kind.valid(text[a:b]) and not (at and found[at - 1][1] > a):
                new.append((a, b, kind.name))
        found = sorted(found + new) if new else found
    return found


def entity_format(kind: str, entity: str) -> str:
    """Entities of one kind and format have the same values to go to."""
    if kind == "ipv4":
        octets = [int(x) for x in entity.split(".")]
        return str(octets[: _special(octets)])
    if kind == "card":
        return f"{entity[0]}|{luhn(entity)}|{len(entity)}"
    if kind == "phone":
        return str(len(entity))
    if kind in ("secret", "aws_key") and all(c in _HEX for c in entity):
        return f"hex{len(entity)}"
    fixed = {"email": range(entity.rfind("."), len(entity)), "iban": range(2)}.get(kind, range(0))
    out = []
    for i, c in enumerate(entity):
        found = None if i in fixed else _place(c)
        out.append(c if not found else found[0][0].upper() if found[0] in _ALPHABETS and c != c.lower() else found[0][0])
    return "".join(out)


def dressed(kind: str, value: str, entity: str) -> str:
    """Another entity of the same format, written as ``value`` is."""
    if kind == "email":
        return "".join(e.upper() if v != v.lower() else e for v, e in zip(value, entity, strict=True))
    if kind in ("phone", "card"):
        own = _only_digits(value)
        new = iter(own[: len(own) - len(entity)] + entity)
        return "".join(next(new) if c.isdigit() else c for c in value)
    if kind == "iban":
        new = iter(entity)
        return "".join(c if c == " " else next(new) for c in value)
    return entity


def replace(text: str, found: list[tuple[int, int, str]], attempts: dict[tuple[str, str], int | str], key: bytes) -> str:
    """``attempts`` has the draw of an entity, or the entity that it becomes."""
    parts, at = [], 0
    for a, b, kind in found:
        value = text[a:b]
        drawn = attempts.get((kind, _BY_NAME[kind].same(value)), 0)
        parts += [text[at:a], dressed(kind, value, drawn) if isinstance(drawn, str) else surrogate(kind, value, drawn, key)]
        at = b
    return "".join([*parts, text[at:]])


def mentions(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind, entity)`` for every mention; mentions of the same entity have the same ``entity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out += [(doc_id, kind, _BY_NAME[kind].same(text[a:b])) for a, b, kind in find(text or "")]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.string()), "entity": pa.array([r[2] for r in out], pa.string())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, kind string, entity string")


def _assign(entities: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True))
            same = [_BY_NAME[k].same(surrogate(k, e, n, key)) for k, e, n in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "entity", "attempt")), pa.array(same, pa.string())], ["kind", "entity", "attempt", "surrogate"])

    return entities.select("kind", "entity", F.col("attempt").cast("int").alias("attempt")).mapInArrow(run, "kind string, entity string, attempt int, surrogate string")


def _ranked(entities: DataFrame, key: bytes) -> DataFrame:
    """``(kind, entity, format, rank)``, the rank a keyed hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("kind").to_pylist(), batch.column("entity").to_pylist(), strict=True))
            rank = [hashlib.blake2b(f"{k}|{e}".encode(), key=key[:64], digest_size=16).hexdigest() for k, e in rows]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("entity"), pa.array([entity_format(k, e) for k, e in rows], pa.string()), pa.array(rank, pa.string())], ["kind", "entity", "format", "rank"])

    return entities.select("kind", "entity").mapInArrow(run, "kind string, entity string, format string, rank string")


def _permuted(rest: DataFrame, kept: DataFrame, key: bytes) -> DataFrame:
    """``(kind, entity, target)``: the entities of a full format in one cycle, so that nobody keeps their own.

    No drawn surrogate is an entity, so the targets are apart from those too. Who is alone takes turns with
    another entity of the format, which gives up what it drew.
    """
    rest = materialize(_ranked(rest, key), "rest")
    alone = rest.groupBy("kind", "format").count().where("count = 1").select("kind", "format")
    partner = _ranked(kept.join(alone.select("kind").distinct(), "kind", "left_semi"), key).join(alone, ["kind", "format"], "left_semi")
    partner = partner.groupBy("kind", "format").agg(F.min_by("entity", F.struct("rank", "entity")).alias("entity"), F.min("rank").alias("rank"))
    cycle = W.partitionBy("kind", "format").orderBy("rank", "entity")
    both = rest.unionByName(partner.select(*rest.columns))
    target = F.coalesce(F.lead("entity").over(cycle), F.first("entity").over(cycle))
    return both.select("kind", "entity", target.alias("target")).where("target <> entity")


def _judged(entities: DataFrame) -> DataFrame:
    """``clash``: another entity has the surrogate, or it is one itself. People of one surname clash together, so that they keep sharing one."""
    first = F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("attempt", "entity"))
    real = entities.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
    judged = entities.withColumn("nth", first).join(real, ["kind", "surrogate"], "left")
    judged = judged.withColumn("clash", (F.col("nth") > 1) | F.coalesce("real", F.lit(False)))
    surname = F.when(F.col("kind") == "person", F.substring_index("entity", " ", -1))
    shared = judged.where("clash and kind = 'person'").select(surname.alias("surname"), F.lit(True).alias("together")).distinct()
    judged = judged.withColumn("surname", surname).join(shared, "surname", "left")
    return judged.withColumn("clash", F.col("clash") | F.coalesce("together", F.lit(False)))


def checked_attempts(docs: DataFrame, key: bytes = DEFAULT_KEY, found: DataFrame | None = None) -> DataFrame:
    """``(kind, entity, attempt, target)`` of the entities that can't have their first surrogate.

    All distinct entities of the corpus are checked together (``found``: their mentions, if they are at hand): a
    surrogate that another entity has, or that is itself an entity of the corpus, is drawn anew. Where a format is so
    full that MAX_ATTEMPTS draws don't find a free value, the entities left over are permuted among themselves: each
    becomes its ``target``, an entity of the corpus by need, but still one of its own.
    """
    spark = docs.sparkSession
    entities = (mentions(docs) if found is None else found).select("kind", "entity").distinct().withColumn("attempt", F.lit(0))
    entities = entities.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entity")  # few rows, but much to compute for each
    entities = materialize(_assign(entities, key), "entities")
    for _ in range(MAX_ATTEMPTS):
        judged = _judged(entities)
        clashing = judged.where("clash")
        if clashing.isEmpty():
            return entities.where("attempt > 0").select("kind", "entity", "attempt", F.lit(None).cast("string").alias("target"))
        kept = judged.where("not clash").select("kind", "entity", "attempt", "surrogate")
        entities = materialize(kept.unionByName(_assign(clashing.withColumn("attempt", F.col("attempt") + 1), key)), "entities")
    judged = _judged(entities)
    moved = materialize(_permuted(judged.where("clash"), judged.where("not clash"), key), "moved")
    drawn = entities.where("attempt > 0").join(moved, ["kind", "entity"], "left_anti")
    return drawn.select("kind", "entity", "attempt", F.lit(None).cast("string").alias("target")).unionByName(moved.select("kind", "entity", F.lit(0).alias("attempt"), "target"))


def _free(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that isn't taken, whatever its case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def replace_pii(docs: DataFrame, key: bytes = DEFAULT_KEY, count: str = "n_replaced") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_replaced`` (or another name, ``count``); every other column stays, but for one of that name.

    The same entity has the same surrogate in all documents, different entities have different ones; case,
    separators, script, gender, number lengths and check digits stay as they were. A null or empty text
    stays as it is with 0; repeated rows are treated alike; null ids don't matter.
    """
    found = materialize(mentions(docs), "mentions")
    attempts = checked_attempts(docs, key, found)
    fields = [c for c in docs.columns if c.lower() != count.lower()]
    extra, rare_id = _free("attempts", docs.columns), _free("rare_id", docs.columns)
    texts = docs.select(*fields, F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int,target:string>>").alias(extra))
    if not attempts.isEmpty():
        rare = found.join(attempts, ["kind", "entity"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "entity", "attempt", "target")).alias(extra))
        rare = rare.withColumnRenamed("doc_id", rare_id)
        texts = docs.select(*fields).join(rare, F.col("doc_id").cast("long").eqNullSafe(F.col(rare_id)), "left").drop(rare_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new, numbers = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column(extra).to_pylist(), strict=True):
                found = find(text) if text else []
                numbers.append(len(found))
                new.append(replace(text, found, {(x["kind"], x["entity"]): x["target"] or x["attempt"] for x in own or []}, key) if found else text)
            yield pa.RecordBatch.from_arrays([*(pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in fields), pa.array(numbers, pa.int64())], [*fields, count])

    schema = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in fields), F.lit(0).cast("long").alias(count)).schema
    return texts.mapInArrow(run, schema)
