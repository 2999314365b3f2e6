"""PII: surrogate generation. Detected entities get keyed, type-consistent replacements.

Entities: e-mail addresses, phone numbers (international, or in the usual national groups, or plain digits after a word such as "tel"), IPv4 and IPv6
addresses, IBANs with right check digits, ids of 3-2-4 digits, payment card numbers, secrets (a token, key or password that is
assigned, the fixed prefixes of well-known key formats, and long hexadecimal strings) and person names after an honorific or academic title, every word of
which begins with an upper-case letter of any script. In a document that names a person so, later or earlier mentions of the name in title or upper case
without honorific count, too: the whole name, the family name, the given name. Names that are common words are not taken alone (given ones) or at the beginning of a sentence
(family ones). Every mention is brought to a canonical form
(lower-cased address, bare digits, ...), so that mentions of one entity in any case or format get one surrogate, written in the
mention's own case and format: coreference stays.

Surrogates come from keyed permutations (Feistel networks over the mixed radix of the entity's own characters): a digit stays
a digit, a letter a letter of its script and case (in names a vowel stays a vowel), lengths and separators stay, a card and an IBAN keep whether their check
digits are right, an address keeps its top-level domain, a phone number its country code. Listed given names go round a cycle in keyed order through
the list of their gender and script, others are drawn from it by the key; family names change letter by letter, alike for all who bear one. A permutation never gives two entities of a format
one surrogate.

Collision checks, in Spark over all distinct entities: a surrogate that is itself an entity of the corpus is
permuted again until it is none (walking on keeps the map one-to-one), and should two entities meet in one
surrogate (of different formats, or by drawn given names), all but the first walk on, too. Only these exceptions form a table.

Nulls stay null, empty texts empty; repeated rows get equal results; extra columns stay, whatever their names. `pii_entities` (replaced) counts the mentions.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwatch.llm.common import cut, fresh, if_small

#: Alphabets a letter is exchanged within.
HEX = ("0123456789abcdef", "0123456789ABCDEF")
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
#: Vowels, which stay vowels in names.
VOWELS = ("aeiou", "AEIOU", "аеиоуыэюя", "АЕИОУЫЭЮЯ")
_HOME = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
_NAME_ALPHABETS = [*VOWELS, *("".join(c for c in a if not any(c in v for v in VOWELS)) for a in ALPHABETS)]
_NAME_HOME = {c: (a, i) for a in _NAME_ALPHABETS for i, c in enumerate(a)}
#: Country calling codes of two digits; 1 and 7 have one, all others three.
CALLING = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): (
        "alice amelia anna berta camille caroline charlotte clara claire diana dora elena elisa emily emma eva frida gloria greta hanna helen irene isabel"
        " julia karla laura lena lucia maria marta martina monica nina nora olga paula petra rosa ruth sara silvia sofia susan tina ursula vera victoria"
    ).split(),
    ("m", "latin"): (
        "adam albert anton boris bruno carl carlos charles daniel david diego emil eric felix frank fred george georg hans henry hugo ivan jack james jan john jonas"
        " karl leo louis lucas lukas marco mark martin max miguel noel oskar oscar otto paul pedro peter rafael robert simon stefan thomas tomas victor viktor william"
    ).split(),
    ("f", "cyrillic"): "анна вера галина дарья елена жанна зоя ирина лидия мария нина ольга полина раиса софия тамара".split(),
    ("m", "cyrillic"): "антон борис виктор глеб денис егор захар иван кирилл лев максим никита олег павел роман сергей".split(),
}
#: Honorifics by gender; u: of either.
HONORIFICS = {
    "m": "Mr Herr Monsieur Señor Sr Don г-н".split(), "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Srta Doña г-жа".split(), "u": "Dr Prof Professor Doctor д-р проф".split(),
}
#: Names that are common words, too; alone they name nobody for certain.
WORDS_TOO = frozenset(
    "april art august autumn bill bishop black brown carol chance chase christian cook dale dawn dean drew earl faith field fisher forest frank gay gene glen grace grant gray green guy hall"
    " hardy hill hope hunt hunter iris ivy joy june king knight lane lee long mark may miller mills moss noble norm page paris park pat penny pierce porter pearl price prince ray reed rich"
    " rob robin rock rose ruby rush rusty sandy short skip small stone storm sue summer taylor victor violet walker wall ward warren waters white will winter wood woods young"
    " groß klein kurz lang neu sommer engel ernst stern berg wolf weiß schwarz braun petit grand blanc noir leroy roi bois fontaine dolores mercedes pilar flores leon cruz paz luz".split()
)
_GENDER = {h: g for g, hs in HONORIFICS.items() for h in hs}
_WORD = r"[^\W\d_]+"
#: A letter of any script that is upper case, as every word of a name begins.
_UPPER = "[" + "".join(chr(i) for i in range(0x10000) if chr(i).isupper() or chr(i).istitle()) + "]"
_TITLE = "|".join(sorted(_GENDER, key=len, reverse=True))
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]*\w@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?i:(?<=token)|(?<=key)|(?<=secret)|(?<=password)|(?<=passwd))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{12,}={0,2})"
    r"|(?P<key>(?<![\w-])(?:sk-|pk_|sk_live_|ghp_|gho_|glpat-|xox[abp]-|AKIA|AIza)[A-Za-z0-9_-]{16,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]))"
    r"|(?P<hex>(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<card>(?<![\w.-])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![\w-]))"
    r"|(?P<id>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3,4}[ .-]|(?:(?<=\+\d)|(?<=\+\d\d)|(?<=\+\d\d\d))[ .-]?\d\d[ .-]|0\d[ .-])\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\(0?\d{0,4}\))?(?:[ .-]?\d{2,4}){2,5}"
    r"|0\d(?:[ .-]\d{2}){4}|(?i:(?:tel|phone|call|mobile|fax)[.: ]{1,3})\d{7,11})(?![\w-]))"
    rf"|(?P<name>(?:\b(?P<title>{_TITLE})\.? (?:(?P<second>{_TITLE})\.? )?|(?<![\w.])(?<!\w\. )(?P<abbreviated>M)\. )(?P<person>(?={_UPPER}){_WORD}(?:[ -](?={_UPPER}){_WORD}){{0,2}}))"
)
KINDS = ("email", "secret", "key", "iban", "ipv6", "hex", "ip", "card", "id", "phone", "name")
_MAY = re.compile(r"@|\d|(?:sk|pk|ghp|gho|glpat|xox)|M\. |" + "|".join(_GENDER))


def _number(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key[:64], digest_size=64).digest(), "big")


def permute(text: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the strings of `text`'s format: characters of a known alphabet change within it, others stay."""
    home = _NAME_HOME if tweak.startswith("name") else _HOME
    homes = [(HEX[0], HEX[0].index(c)) if tweak == "hex" and c in HEX[0] else home.get(c) for c in text]
    at = [i for i, h in enumerate(homes) if h]
    if not at:
        return text
    shape = "".join("h" if h and tweak == "hex" else h[0][0] if h else c for h, c in zip(homes, text))
    half = len(at) // 2
    sides, sizes = [0, 0], [1, 1]
    for n, i in enumerate(at):
        s = int(n >= half)
        sides[s] = sides[s] * len(homes[i][0]) + homes[i][1]
        sizes[s] *= len(homes[i][0])
    for r in range(6):
        s = r % 2
        sides[s] = (sides[s] + _number(key, tweak, shape, r, sides[1 - s])) % sizes[s]
    out = list(text)
    for n in range(len(at) - 1, -1, -1):
        i, s = at[n], int(n >= half)
        sides[s], d = divmod(sides[s], len(homes[i][0]))
        out[i] = homes[i][0][d]
    return "".join(out)


def _check_digit(digits: str) -> int:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (2 if n % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, body: str) -> int:
    """The check digits of an IBAN (ISO 7064, 97-10)."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _groups(address: str) -> list[int]:
    """The eight groups of an IPv6 address; none if it isn't one."""
    head, gap, tail = address.partition("::")
    left, right = ([int(g, 16) for g in side.split(":") if g] for side in (head, tail))
    missing = 8 - len(left) - len(right)
    return [*left, *[0] * missing, *right] if (missing > 0) == bool(gap) and missing >= 0 else []


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def canonical(kind: str, m: re.Match) -> str:
    """The entity that a mention names, as 'kind:value'."""
    text = m[kind]
    if kind == "email":
        return f"email:{text.lower()}"
    if kind in ("secret", "hex"):
        value = re.search(r"[A-Za-z0-9+/_-]+={0,2}$", text)[0]
        return f"hex:{value.lower()}" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else f"secret:{value}"
    if kind == "ip":
        return "ip:" + ".".join(str(int(p)) for p in text.split("."))
    if kind == "ipv6":
        return "ipv6:" + ":".join(f"{g:04x}" for g in _groups(text))
    if kind == "iban":
        return f"iban:{text.replace(' ', '')}"
    if kind == "key":
        prefix = re.match(r"sk_live_|[A-Za-z]+[-_]|AKIA|AIza", text)[0]
        return f"key:{prefix} {text[len(prefix):]}"
    if kind == "name":
        words = m["person"].lower().replace("-", " - ").split()
        return f"name-{_gender(m, words)}:{' '.join(words)}"
    return f"{kind}:{'+' if text.startswith('+') else ''}{re.sub(r'[^0-9]', '', text)}"


def _gender(m: re.Match, words: list[str]) -> str:
    """f, m or u: as the titles say, else as the lists of given names do."""
    said = {_GENDER[t] for t in (m["title"], m["second"]) if t} - {"u"} or {g for g, script in GIVEN if len(words) > 1 and words[0] in GIVEN[g, script]}
    return "m" if m["abbreviated"] else said.pop() if len(said) == 1 else "u"


_ROUNDS: dict = {}


def _round(names: list[str], key: bytes, kind: str) -> list[str]:
    """`names` in keyed order; remembered."""
    at = (names[0], key, kind)
    if at not in _ROUNDS:
        _ROUNDS[at] = sorted(names, key=lambda n: _number(key, kind, "round", n))
    return _ROUNDS[at]


def next_of(entity: str, key: bytes) -> str:
    """One step of the keyed permutation of an entity's format."""
    kind, _, value = entity.partition(":")
    if kind == "email":
        name, _, rest = value.rpartition(".")
        return f"{kind}:{permute(name, key, kind)}.{rest}"
    if kind == "ip":
        n, k = int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 16
        left, right = divmod(n, k)
        for r in range(3):
            left = (left + _number(key, "ip", 2 * r, right)) % k
            right = (right + _number(key, "ip", 2 * r + 1, left)) % k
        return "ip:" + ".".join(map(str, (left * k + right).to_bytes(4, "big")))
    if kind == "card":
        body, off = value[:-1], (int(value[-1]) - _check_digit(value[:-1])) % 10
        body = permute(body, key, kind)
        return f"card:{body}{(_check_digit(body) + off) % 10}"
    if kind == "ipv6":
        groups = permute(value.replace(":", ""), key, "hex")
        return f"ipv6:{':'.join(groups[i : i + 4] for i in range(0, 32, 4))}"
    if kind == "iban":
        country, off, body = value[:2], (int(value[2:4]) - _iban_check(value[:2], value[4:])) % 97, permute(value[4:], key, kind)
        return f"iban:{country}{(_iban_check(country, body) + off) % 97:02d}{body}"
    if kind == "key":
        prefix, _, body = value.partition(" ")
        return f"key:{prefix} {permute(body, key, kind)}"
    if kind == "phone":
        head = (2 if value[1:2] in ("1", "7") else 3 if value[1:3] in CALLING else 4) if value.startswith("+") else int(value.startswith("0"))
        return f"phone:{value[:head]}{permute(value[head:], key, kind)}"
    if kind.startswith("name"):
        words = value.split(" ")
        script = _script(words[0])
        names = _round([n for g in ("f", "m") if kind[-1] in (g, "u") for n in GIVEN[g, script]], key, kind)
        if len(words) > 1 and words[1] != "-":  # the next in keyed order; names that aren't listed enter by the key
            at = names.index(words[0]) + 1 if words[0] in names else _number(key, kind, words[0])
            return f"{kind}:{' '.join([names[at % len(names)]] + [permute(w, key, 'name') for w in words[1:]])}"
        return f"{kind}:{' '.join(permute(w, key, 'name') for w in words)}"  # a family's name is one, whatever the title
    return f"{kind}:{permute(value, key, kind)}"


def written(kind: str, m: re.Match, surrogate: str) -> str:
    """The surrogate in the mention's case and format."""
    text, value = m[0], surrogate.partition(":")[2]
    if kind in ("card", "phone", "id"):
        digits = iter(value.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in text)
    if kind == "ip":
        return value
    if kind == "ipv6":
        value = ":".join(f"{int(g, 16):x}" for g in value.split(":"))
        return value.upper() if any("A" <= c <= "F" for c in text) else value
    if kind == "iban":
        letters = iter(value)
        return "".join(c if c == " " else next(letters) for c in text)
    if kind == "key":
        return value.replace(" ", "")
    if kind == "name":
        start = m.start("person") - m.start()
        words = iter(value.replace(" - ", " ").split())
        cased = re.sub(_WORD, lambda w: (lambda v: v.upper() if w[0].isupper() and len(w[0]) > 1 else v.capitalize())(next(words)), m["person"])
        return text[:start] + cased
    if kind in ("secret", "hex"):
        old = re.search(r"[A-Za-z0-9+/_-]+={0,2}$", text)[0]
        return text[: len(text) - len(old)] + (value.upper() if old.isupper() and surrogate.startswith("hex") else value)
    return value.upper() if text.isupper() else value


def _kind(m: re.Match) -> str:
    return next(k for k in KINDS if m[k] is not None)


def _is_one(kind: str, m: re.Match) -> bool:
    """Whether a match of the pattern is an entity: check digits and lengths."""
    if kind == "iban":
        value = m[0].replace(" ", "")
        return _iban_check(value[:2], value[4:]) == int(value[2:4])
    if kind == "ipv6":
        return len(_groups(m[0])) == 8 and sum(c.isdigit() for c in m[0]) > 0
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in m[0]) <= 15
    return True


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize()


#: What stands before the first word of a sentence.
_BEGINS = re.compile(r"(?:^|[.!?\n…]['\"»”)]?\s*['\"«„“(]?)$")


def mentions(text: str) -> list[tuple[int, int, str, Callable[[str], str]]]:
    """(start, end, entity, how its surrogate is written there) of all mentions in a text, in order, none overlapping."""
    if not text or not _MAY.search(text):
        return []
    out, people = [], {}
    for m in PATTERN.finditer(text):
        kind = _kind(m)
        if not _is_one(kind, m):
            continue
        entity = canonical(kind, m)
        out.append((m.start(), m.end(), entity, lambda s, kind=kind, m=m: written(kind, m, s)))
        if kind == "name" and "-" not in m["person"]:
            words = m["person"].split(" ")
            for lo, hi in {(0, len(words)), (len(words) - 1, len(words)), (0, 1)}:
                name = " ".join(words[lo:hi]).lower()
                given = hi < len(words)
                if len(name) > 1 + given and not (given and name in WORDS_TOO):
                    people.setdefault(name, (entity, lo, hi))
    if people:
        bare = re.compile(r"(?<![\w@.-])(?:" + "|".join(map(re.escape, sorted(people, key=lambda n: (-len(n), n)))) + r")(?![\w@-])", re.IGNORECASE)
        starts, known = [o[0] for o in out], list(out)
        for m in bare.finditer(text):
            i = bisect_right(starts, m.start()) - 1
            if i >= 0 and known[i][1] > m.start() or i + 1 < len(known) and known[i + 1][0] < m.end():
                continue
            parts = m[0].split(" ")
            if m[0].lower() not in people or not all(w[0].isupper() for w in parts) or m[0].lower() in WORDS_TOO and _BEGINS.search(text, max(0, m.start() - 4), m.start()):
                continue
            entity, lo, hi = people[m[0].lower()]
            put = lambda s, lo=lo, hi=hi, parts=parts: " ".join(map(_cased, parts, s.partition(":")[2].split(" ")[lo:hi]))
            out.append((m.start(), m.end(), entity, put))
        out.sort(key=lambda o: o[0])
    return out


def _found(batches):
    for b in batches:
        seen = {entity: None for text in b.column("text").to_pylist() for _, _, entity, _ in mentions(text)}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["entity"])


def surrogates(docs: DataFrame, key: bytes, rounds: int = 12) -> DataFrame:
    """(entity, surrogate) of the entities whose surrogate isn't simply one step of the permutation. Usually few or none."""
    entities = cut(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_found, "entity string").distinct(), "entities")

    def stepped(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("entity"), pa.array([next_of(v, key) for v in b.column("now").to_pylist()], pa.string())], ["entity", "now"])

    step = lambda df: df.mapInArrow(stepped, "entity string, now string")
    now = cut(step(entities.select("entity", F.col("entity").alias("now"))), "surrogates").withColumn("walked", F.lit(False))
    for _ in range(rounds):
        real = now.join(entities.select(F.col("entity").alias("now")), "now", "left_semi").select("entity", "now")
        first = now.groupBy("now").agg(F.count("*").alias("c"), F.min("entity").alias("first")).where("c > 1")
        double = now.join(first, "now").where(F.col("entity") != F.col("first")).select("entity", "now")
        again = cut(real.union(double).distinct(), "walk-on")
        if not again.take(1):
            return now.where("walked").select("entity", F.col("now").alias("surrogate"))
        moved = step(again).withColumn("walked", F.lit(True))
        now = cut(now.join(again.select("entity"), "entity", "left_anti").select("entity", "now", "walked").union(moved), "surrogates")
    raise RuntimeError("surrogates still collide; choose another key")


def replace(docs: DataFrame, key: bytes = b"docwatch", few: int = 100_000) -> DataFrame:
    """`docs` with surrogates in `text`, and pii_entities, the number of mentions replaced.

    Up to `few` exceptions (they are counted first) are sent to all tasks; more are joined to the texts that hold them.
    """
    odd = cut(surrogates(docs, key), "exceptions")
    kept = docs.select(*[c for c in docs.columns if c != "pii_entities"])
    schema = T.StructType([*kept.schema.fields, T.StructField("pii_entities", T.IntegerType())])
    place = kept.columns.index("text")

    def rewrite(texts: list, others: list[dict]):
        new, counts = [], []
        for text, other in zip(texts, others):
            parts, at, found = [], 0, mentions(text)
            for start, end, entity, put in found:
                parts += [text[at:start], put(other.get(entity) or next_of(entity, key))]
                at = end
            new.append("".join([*parts, text[at:]]) if found else text)
            counts.append(len(found))
        return new, counts

    def out(b, names, new, counts):
        columns = [b.column(c) for c in names]
        columns[place] = pa.array(new, pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], names=[*names, "pii_entities"])

    names = kept.columns
    if odd.limit(few + 1).count() <= few:
        told = docs.sparkSession.sparkContext.broadcast({r["entity"]: r["surrogate"] for r in odd.collect()})

        def run(batches):
            for b in batches:
                texts = b.column("text").to_pylist()
                yield out(b, names, *rewrite(texts, [told.value] * len(texts)))

        return kept.mapInArrow(run, schema)

    def held(batches):
        for b in batches:
            rows = [(k, e) for k, text in zip(b.column("tkey").to_pylist(), b.column("text").to_pylist()) for e in {m[2] for m in mentions(text)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["tkey", "entity"])

    text_key, other = fresh(kept, "text_key", "other")
    keyed = kept.withColumn(text_key, F.xxhash64("text"))
    pairs = keyed.select(F.col(text_key).alias("tkey"), "text").mapInArrow(held, "tkey long, entity string").distinct().join(if_small(odd), "entity")
    of_text = pairs.groupBy(F.col("tkey").alias(text_key)).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(other))

    def run_with(batches):
        for b in batches:
            yield out(b, names, *rewrite(b.column("text").to_pylist(), [dict(x or ()) for x in b.column(other).to_pylist()]))

    return keyed.join(of_text, text_key, "left").select(*names, other).mapInArrow(run_with, schema)
