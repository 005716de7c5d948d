"""Surrogates for personal data and secrets (native: DataFrame functions only).

Entities are found by one pattern. What an entity names, however it is written, is its canonical form: an address
without regard to case, the digits of a phone or card number, an account number without spaces, a secret without the
words before it, a name without its title's mark and the case of its letters, with the title's gender. A surrogate is
derived from a key and the canonical form and then written as the entity is (coreference): each digit becomes a digit,
each letter a letter of its case and script, marks and spaces stay, an address stays an address, a card number passes
its check digit, a name takes a name of its gender and script, and a family name is the same with and without a
given name before it.

Distinct canonical forms are gathered over the corpus, pre-aggregated, and their surrogates checked for collisions:
with one another and with any form that occurs. Those that collide draw again, counting up, until none is
left. Only redrawn forms differ from the plain derivation, so texts without one are rewritten without a
join, and the few others are joined on the redrawn ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .decontam import let

#: Redrawn entities are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
MOST_DRAWS = 50

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+(?:[ \u00a0]\p{Lu}[\p{L}'’-]+){0,2}"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|г-жа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|г-н"
#: Titles of either gender; the name then takes one by its hash.
EITHER = "Dr|Prof|Professor|Доктор"
#: Kind, pattern, and a cheaper pattern that holds wherever it does. Earlier kinds win where two begin alike.
KINDS: list[tuple[str, str]] = [
    ("email", r"(?<![\w.%+@-])[\p{L}\d][\p{L}\d._%+-]{0,63}@[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?(?:\.[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?)*\.\p{L}{2,}"),
    ("secret", r"(?i:(?<![\p{L}\d])(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token)[\"']?\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,}))"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![A-Za-z0-9])(?:ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9-]{16,}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"),
    ("name", rf"(?<![\p{{L}}])(?:{FEMALE}|{MALE}|{EITHER})\.?[ \u00a0]{_NAME}"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: Holds for every text that PATTERN is found in; most texts fail it at once.
HINT = rf"[@=:]|\d[\d. ()-]{{3}}|AKIA|ASIA|ghp_|gho_|sk-|xox|(?:{FEMALE}|{MALE}|{EITHER})\.?[ \u00a0]\p{{Lu}}"

_FIRST = {
    ("f", "latin"): "Anna Clara Edith Greta Helen Irene Julia Karin Laura Maria Nora Paula Rosa Sofia Vera Wanda".split(),
    ("m", "latin"): "Adam Bruno Carlo David Emil Felix Georg Henry Ivan Jonas Karl Leon Martin Oscar Peter Victor".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Софья Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Юрий".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke ko la le lo ma me mo na ne ra re ro sa se so ta te va".split(),
    "cyrillic": "ба бе бо да де до га ка ке ко ла ле ло ма ме мо на не ра ре ро са се со та те ва ви зо".split(),
}


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern the whole entity matches."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(F.regexp_like(entity, F.lit(rf"\A(?:{pattern})\z")), F.lit(name)).otherwise(out)
    return out


def card_sum(digits: Column, doubled: int) -> Column:
    """The check sum of payment cards over digits from the right; those at odd (1) or even (0) places are doubled."""

    def add(total: Column, d: Column, i: Column) -> Column:
        x = d.cast("int")
        return total + F.when(i % 2 != doubled, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2))

    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(each, F.lit(0), lambda total, x: add(total, x["d"], x["i"]))


#: Stands between the parts of a canonical form.
_SEP = "\x1f"


def canonical(entity: Column) -> Column:
    """What an entity names: its kind, what stays before the part that is drawn anew, that part, and what stays after."""
    return let(kind_of(entity), lambda kind: let(F.struct(kind.alias("kind"), _head(entity, kind).alias("head"), _tail(entity, kind).alias("tail")), lambda x: _canonical(entity, x)))


def _head(entity: Column, kind: Column) -> Column:
    """What stays as it is before the part that is drawn anew."""
    return (
        F.when(kind == "secret", F.regexp_replace(entity, rf"{_VALUE}$", ""))
        .when(kind == "key", F.regexp_extract(entity, r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-)", 0))
        .when(kind == "iban", F.substr(entity, F.lit(1), F.lit(2)))
        .when(kind == "phone", F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0))
        .when(kind == "name", F.regexp_extract(entity, rf"^(?:{FEMALE}|{MALE}|{EITHER})\.?[ \u00a0]", 0))
        .otherwise("")
    )


def _tail(entity: Column, kind: Column) -> Column:
    return F.when(kind == "email", F.regexp_extract(entity, r"\.\p{L}{2,}$", 0)).otherwise("")


def _core(entity: Column, x: Column) -> Column:
    return F.substr(entity, F.length(x["head"]) + 1, F.length(entity) - F.length(x["head"]) - F.length(x["tail"]))


def _canonical(entity: Column, x: Column) -> Column:
    kind, core = x["kind"], _core(entity, x)
    gender = F.when(F.regexp_like(x["head"], F.lit(rf"^(?:{FEMALE})[. \u00a0]")), "f").when(F.regexp_like(x["head"], F.lit(rf"^(?:{EITHER})[. \u00a0]")), "n").otherwise("m")
    # Of a prefix only what tells one thing from another is kept.
    before = F.when(kind == "name", gender).when(kind == "secret", F.lit("")).otherwise(F.lower(x["head"]))
    middle = (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(core, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(core, " ", ""))
        .when(kind == "secret", F.regexp_replace(core, r"^[\"']|[\"']$", ""))
        .when(kind == "name", F.regexp_replace(F.lower(core), "[ \u00a0]+", " "))
        .when(kind == "email", F.lower(core))
        .otherwise(core)
    )
    return F.concat_ws(_SEP, kind, before, middle, F.lower(x["tail"]))


def digest(canon: Column, draw: Column, key: str) -> Column:
    """256 bits as 64 hex digits, keyed at both ends."""
    return F.sha2(F.concat_ws(_SEP, F.lit(key), draw.cast("string"), F.sha2(F.concat(F.lit(key), canon), 256)), 256)


def _number(hexes: Column, at: Column, digits: int = 4) -> Column:
    """A number below 16**digits from hex digits at place ``at`` (from 0), round and round the 64."""
    start = F.pmod(at, F.lit(64 - digits)) + 1
    return F.conv(F.substr(hexes, start, F.lit(digits)), 16, 10).cast("int")


_VALUE = r"(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;=:]{6,})"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYR_LOWER = "абвгдежзиклмнопрстуфхцчшэюя"
_GREEK_LOWER = "αβγδεζηθικλμνξοπρστυφχψω"


def reshaped(text: Column, hexes: Column, hex_only: Column | None = None) -> Column:
    """Each digit another digit, each letter a letter of its case and script, anything else as it is."""
    chars = F.split(text, "")

    def pick(alphabet: str, n: Column) -> Column:
        return F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        # Beyond 60 characters the digest starts anew, so its turn is added in.
        n = _number(hexes, i) + F.floor(i / 60).cast("int") * 7
        low = F.lit(_LOWER) if hex_only is None else F.when(hex_only, F.lit("abcdef")).otherwise(F.lit(_LOWER))
        out = F.when(c.rlike(r"^\d$"), pick("0123456789", n))
        out = out.when(c.rlike("^[a-z]$"), F.substr(low, F.pmod(n, F.length(low)) + 1, F.lit(1)))
        out = out.when(c.rlike("^[A-Z]$"), pick(_UPPER, n))
        for script, letters in (("IsCyrillic", _CYR_LOWER), ("IsGreek", _GREEK_LOWER)):
            out = out.when(c.rlike(rf"^[\p{{{script}}}&&\p{{Lu}}]$"), pick(letters.upper(), n))
            out = out.when(c.rlike(rf"^[\p{{{script}}}&&\p{{L}}]$"), pick(letters, n))
        return out.when(c.rlike(r"^\p{Lu}$"), pick("ÀÂÄÉÈÖÜÑÇ", n)).when(c.rlike(r"^\p{L}$"), pick("àâäéèöüñç", n)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def stand_in(canon: Column, draw: Column, key: str) -> Column:
    """The canonical form that replaces ``canon`` at a draw (0 first). Depends on nothing else."""
    return let(F.split(canon, _SEP, -1), lambda p: let(digest(canon, draw, key), lambda h: _stand_in(p, h, draw, key)))


def _stand_in(p: Column, h: Column, draw: Column, key: str) -> Column:
    kind, before, middle, after = (F.get(p, F.lit(k)) for k in range(4))

    def checked(d: Column) -> Column:
        """The last digit set so that the check sum holds, if it held for the entity."""
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        return F.when(card_sum(middle, 1) % 10 == 0, F.concat(body, ((10 - card_sum(body, 0) % 10) % 10).cast("string"))).otherwise(d)

    drawn = reshaped(middle, h, F.regexp_like(middle, F.lit("^[0-9a-f]+$")) & (kind == "secret"))
    octet = lambda k, lo, n: (F.pmod(_number(h, F.lit(k)), F.lit(n)) + lo).cast("string")
    ip = F.concat_ws(".", octet(0, 1, 223), octet(7, 0, 256), octet(14, 0, 256), octet(21, 1, 254))
    new = F.when(kind == "card", let(drawn, checked)).when(kind == "ip", ip).when(kind == "name", _name(before, middle, h, draw, key)).otherwise(drawn)
    return F.concat_ws(_SEP, kind, before, new, after)


def _name(gender: Column, name: Column, h: Column, draw: Column, key: str) -> Column:
    """A name, in lower case, of the gender, of the first letter's script and of as many parts.

    The last part follows from the last part of ``name`` alone, whatever is before it, unless it is drawn again.
    """
    parts = F.split(name, " ")
    script = F.when(F.regexp_like(name, F.lit(r"^\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    either = F.when(F.pmod(_number(h, F.lit(50)), F.lit(2)) == 0, "f").otherwise("m")
    firsts = F.create_map(*[x for (g, s), names in _FIRST.items() for x in (F.lit(g + s), F.array(*[F.lit(n.lower()) for n in names]))])
    some = F.create_map(*[x for s, syllables in _SYLLABLES.items() for x in (F.lit(s), F.array(*map(F.lit, syllables)))])
    pick = lambda array, hexes, k: F.get(array, F.pmod(_number(hexes, k), F.size(array)))
    family = F.when(draw == 0, digest(F.concat(F.lit("family"), F.element_at(parts, -1)), draw, key)).otherwise(h)
    made = lambda hexes, i: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: pick(F.element_at(some, script), hexes, i * 23 + j * 5 + 5)), "")
    given = pick(F.element_at(firsts, F.concat(F.when(gender == "n", either).otherwise(gender), script)), h, F.lit(1))

    def part(w: Column, i: Column) -> Column:
        return F.when(i == F.size(parts) - 1, made(family, F.lit(0))).when(i == 0, given).otherwise(made(h, i))

    return F.array_join(F.transform(parts, part), " ")


def written_as(entity: Column, canon: Column) -> Column:
    """A canonical form written as ``entity`` is: its head, tail, marks and the case of its letters."""
    parts = F.struct(kind_of(entity).alias("kind"), F.get(F.split(canon, _SEP, -1), F.lit(2)).alias("new"))
    return let(parts, lambda p: let(F.struct(p["kind"].alias("kind"), p["new"].alias("new"), _head(entity, p["kind"]).alias("head"), _tail(entity, p["kind"]).alias("tail")), lambda x: _written(entity, x)))


def _written(entity: Column, x: Column) -> Column:
    core, new = _core(entity, x), x["new"]
    start = F.struct(F.lit("").alias("made"), F.lit(1).alias("at"))

    def lay(kept: str) -> Column:
        """The characters of the new form in a row, with those of the entity that match ``kept`` in their places."""

        def one(done: Column, c: Column) -> Column:
            n = F.substr(new, done["at"], F.lit(1))
            cased = F.when(c.rlike(r"^\p{Lu}$"), F.upper(n)).otherwise(n)
            stays = c.rlike(kept)
            return F.struct(F.concat(done["made"], F.when(stays, c).otherwise(cased)).alias("made"), (done["at"] + F.when(stays, 0).otherwise(1)).alias("at"))

        return F.aggregate(F.split(core, ""), start, one, lambda done: done["made"])

    name = F.when(F.regexp_like(core, F.lit(r"\p{Ll}")), F.initcap(new)).otherwise(F.upper(new))
    # The spaces between the parts of a name stay as they are.
    spaced = F.array_join(F.zip_with(F.split(name, " "), F.split(F.regexp_replace(core, "[^ \u00a0]+", "x"), "x"), lambda w, gap: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(w, F.lit("")))), "")
    made = (
        F.when(x["kind"].isin("phone", "card", "ssn"), lay(r"^\D$"))
        .when(x["kind"] == "iban", lay("^ $"))
        .when(x["kind"] == "secret", lay("^[\"']$"))
        .when(x["kind"] == "email", lay("^$"))
        .when(x["kind"] == "name", spaced)
        .otherwise(new)
    )
    return F.concat(x["head"], made, x["tail"])


def entities(text: Column) -> Column:
    """The entities of a text in order; most texts are told by HINT to have none."""
    return F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def draws(found: DataFrame, key: str) -> DataFrame:
    """canon, draw of the distinct canonical forms whose first surrogate would collide; ``found`` has them all once.

    A collision is a surrogate that another form has (the smaller form keeps it) or that is itself a form of the
    corpus, its own included. Each round writes what it redrew.
    """
    one = lambda d: d.withColumn("s", stand_in(F.col("canon"), F.col("draw"), key))
    drawn = written(one(found.select("canon", F.lit(0).alias("draw"))), "surrogates")
    redrawn = None
    for _ in range(MOST_DRAWS):
        owner = drawn.groupBy("s").agg(F.min(F.struct(F.col("draw") * -1, F.col("canon"))).alias("o"), F.count("*").alias("n"))
        twice = drawn.join(owner.where("n > 1"), "s").where(F.struct(F.col("draw") * -1, F.col("canon")) != F.col("o")).select("canon")
        real = drawn.join(found.select(F.col("canon").alias("s")), "s", "left_semi").select("canon")
        bad = written(twice.union(real).distinct(), "collisions")
        if bad.isEmpty():
            break
        again = one(drawn.join(bad, "canon", "left_semi").select("canon", (F.col("draw") + 1).alias("draw")))
        drawn = written(drawn.join(bad, "canon", "left_anti").union(again.select(*drawn.columns)), "surrogates")
        redrawn = drawn.where("draw > 0").select("canon", "draw")
    else:
        raise RuntimeError("surrogates still collide; are there more entities of a kind than surrogates?")
    return redrawn if redrawn is not None else found.limit(0).select("canon", F.lit(0).alias("draw"))


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_entities`` (int) added (replaced, if there).

    ``key`` is secret: who has it can check a guess. Null texts stay null with 0 entities; texts without an entity
    stay as they are, byte for byte. Rows keep their number and other columns. Entities of one canonical form get
    one surrogate, each written as it is, and different ones different ones, over the whole table, and no surrogate
    is an entity that occurs.
    """
    e, z = fresh(docs, "_entities"), fresh(docs, "_draws")
    own = [c for c in docs.columns if c.lower() != "n_entities"]
    # The pattern goes over each text once; the rows are written with what it found.
    base = written(docs.select(*own, entities(F.col("text")).alias(e)), "found", compression="zstd")
    spelled = base.select(F.explode(F.array_distinct(e)).alias("entity")).distinct()
    spelled = written(spelled.withColumn("canon", canonical(F.col("entity"))), "entities")
    redrawn = draws(spelled.select("canon").distinct(), key)
    redrawn = written(spelled.join(redrawn, "canon").select("entity", "draw"), "redrawn")
    many = redrawn.count()
    if many:
        base = _with_draws(base, redrawn, e, z, many)
    else:
        base = base.withColumn(z, F.lit(None).cast("map<string,int>"))
    pieces = F.split(F.col("text"), PATTERN, -1)

    def made(x: Column) -> Column:
        draw = F.coalesce(F.get(F.map_values(F.map_filter(F.col(z), lambda k, v: k == x)), F.lit(0)), F.lit(0))
        return let(stand_in(canonical(x), draw, key), lambda new: written_as(x, new))

    joined = F.array_join(
        F.zip_with(pieces, F.transform(F.col(e), made), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    text = F.when(F.size(e) > 0, joined).otherwise(F.col("text"))
    return base.select(
        *[text.alias(c) if c.lower() == "text" else F.col(c) for c in own], F.greatest(F.coalesce(F.size(e), F.lit(0)), F.lit(0)).alias("n_entities")
    )


def _with_draws(base: DataFrame, redrawn: DataFrame, e: str, z: str, many: int) -> DataFrame:
    """``base`` with a map of the draws of its redrawn entities: joined by the set of entities, not by row."""
    sets = base.where(F.size(e) > 0).select(F.col(e).alias("es")).distinct()
    exploded = sets.select("es", F.explode("es").alias("entity"))
    side = redrawn.select("entity", "draw")
    hit = exploded.join(F.broadcast(side) if many <= BROADCAST_ROWS else side, "entity")
    maps = hit.distinct().groupBy("es").agg(F.map_from_entries(F.collect_list(F.struct("entity", "draw"))).alias(z))
    maps = written(maps, "draw-sets")
    small = maps.count() <= BROADCAST_ROWS // 10
    return base.join(F.broadcast(maps) if small else maps, base[e] == maps["es"], "left").drop("es")


def op8_pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, and n_entities of every document."""
    return replace_pii(docs.select("doc_id", "text"), key)
