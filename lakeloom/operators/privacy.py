"""Hashes, keyed pseudonyms, masks, encryption and column policies."""

from __future__ import annotations

import hashlib
import hmac
import os
import random
import re
from collections.abc import Sequence
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256(c: str | Column) -> Column:
    """An unsalted hash: it can be reversed with a dictionary."""
    return F.sha2(_col(c).cast("string"), 256)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)


def hmac_sha256(c: str | Column, key: bytes) -> Column:
    """HMAC (RFC 2104) from built-in functions, in lowercase hex; null stays null."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), _col(c).cast("string").cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def hmac_sql(expr: str, key: bytes) -> str:
    """SQL text of hmac_sha256."""
    inner, outer = (p.hex().upper() for p in _pads(key))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', CAST(CAST({expr} AS STRING) AS BINARY)), 256))), 256)"


def hmac_python(value: str, key: bytes) -> str:
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()


def key_from_env(name: str = "LAKELOOM_PSEUDONYM_KEY", demo: bool = False) -> bytes:
    """The key of an environment variable; a demonstration key only if asked for."""
    if value := os.environ.get(name):
        return value.encode()
    if demo:
        return b"demonstration only"
    raise RuntimeError(f"{name} is not set")


def token_vault(df: DataFrame, column: str) -> DataFrame:
    """(value, token) with a random token for each distinct value. Store it before use: another evaluation makes other tokens."""
    return df.select(F.col(column).alias("value")).filter("value is not null").distinct().withColumn("token", F.concat(F.lit("tok_"), F.regexp_replace(F.uuid(), "-", "")))


def tokenize(df: DataFrame, column: str, vault: DataFrame) -> DataFrame:
    """The column's values replaced by their tokens; null for values that the vault lacks."""
    book = vault.select(F.col("value").alias("__v"), F.col("token").alias("__t"))
    return df.join(book, F.col(column) == F.col("__v"), "left").withColumn(column, F.col("__t")).drop("__v", "__t")


def subject_keys(df: DataFrame, subject: str) -> DataFrame:
    """A random 256-bit key in hex for each subject; store it before use."""
    return df.select(subject).filter(F.col(subject).isNotNull()).distinct().withColumn("key_hex", F.regexp_replace(F.concat(F.uuid(), F.uuid()), "-", ""))


def encrypt(c: str | Column, key_hex: str | Column) -> Column:
    return F.base64(F.aes_encrypt(_col(c).cast("string"), F.unhex(_col(key_hex))))


def decrypt(c: str | Column, key_hex: str | Column) -> Column:
    """Null with a wrong or a deleted key."""
    return F.try_aes_decrypt(F.unbase64(_col(c)), F.unhex(_col(key_hex))).cast("string")


def mask_format(c: str | Column) -> Column:
    """Upper case to X, lower case to x, digits to 9."""
    return F.mask(_col(c).cast("string"), F.lit("X"), F.lit("x"), F.lit("9"), F.lit(None))


def mask_format_python(value: object) -> str:
    return "NULL" if value is None else "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in str(value))


def mask_partial(c: str | Column, keep: int = 2) -> Column:
    """Stars for all but the last ``keep`` characters."""
    text = _col(c).cast("string")
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(text) - keep, F.lit(0))), F.right(text, F.lit(keep)))


def mask_email(c: str | Column) -> Column:
    """The first letter and the domain; three stars for what is no address."""
    text = _col(c).cast("string")
    return F.when(text.rlike("^[^@]+@[^@]+$"), F.concat(F.left(text, F.lit(1)), F.lit("***@"), F.substring_index(text, "@", -1))).when(text.isNotNull(), "***")


def mask_cpf(c: str | Column) -> Column:
    """The middle six of eleven digits; three stars for anything else."""
    digits = F.regexp_replace(_col(c).cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) == 11, F.concat(F.lit("***."), F.substring(digits, 4, 3), F.lit("."), F.substring(digits, 7, 3), F.lit("-**"))).when(digits.isNotNull(), "***")


#: What is taken out of free text, in this order (an address comes before what could be part of it).
SCRUBS = (
    (r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "<EMAIL>"),
    (r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "<CPF>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"(\+?55\s?)?\(?\b\d{2}\)?\s?9?\d{4}[-\s]?\d{4}\b", "<TELEFONE>"),
    (r"(?<![\w@])@[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})\b", "<USUARIO>"),
)


def scrub(c: str | Column) -> Column:
    """Mail addresses, tax numbers, IP addresses, phone numbers and mentions replaced by markers."""
    text = _col(c)
    for pattern, marker in SCRUBS:
        text = F.regexp_replace(text, pattern, marker)
    return text


def cpf_valid(c: str | Column) -> Column:
    """Both check digits of an eleven-digit tax number are right, and not all digits are the same."""
    d = F.transform(F.split(F.regexp_replace(_col(c).cast("string"), "[^0-9]", ""), ""), lambda x: x.try_cast("int"))

    def check(n: int) -> Column:
        weighted = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, i: s + F.element_at(d, i) * (n + 2 - i))
        return F.when(weighted % 11 < 2, 0).otherwise(11 - weighted % 11)

    eleven = F.length(F.regexp_replace(_col(c).cast("string"), "[^0-9]", "")) == 11
    return F.coalesce(F.when(eleven, (F.size(F.array_distinct(d)) > 1) & (F.element_at(d, 10) == check(9)) & (F.element_at(d, 11) == check(10))), F.lit(False))


def cpf_fake(rng: random.Random) -> str:
    digits = [rng.randrange(10) for _ in range(9)]
    for n in (9, 10):
        rest = sum(d * (n + 1 - i) for i, d in enumerate(digits)) % 11
        digits.append(0 if rest < 2 else 11 - rest)
    return "".join(map(str, digits))


class Level(IntEnum):
    PUBLIC, INTERNAL, CONFIDENTIAL, RESTRICTED = range(4)


@dataclass(frozen=True)
class ColumnPolicy:
    """treatment: none, sha256, hmac, format, partial, email, cpf or drop."""

    column: str
    level: Level
    personal: bool
    treatment: str = "none"


TREATMENTS = ("none", "sha256", "hmac", "format", "partial", "email", "cpf", "drop")


def personal_columns(policies: Sequence[ColumnPolicy]) -> list[str]:
    return [p.column for p in policies if p.personal]


def treated(p: ColumnPolicy, key: bytes) -> Column | None:
    """The column as a role without access sees it; None if it is dropped."""
    if p.treatment not in TREATMENTS:
        raise ValueError(f"{p.column}: a view can't apply {p.treatment}")
    if p.treatment == "drop":
        return None
    c = F.col(p.column)
    made = {"none": lambda: c, "sha256": lambda: sha256(c), "hmac": lambda: hmac_sha256(c, key), "format": lambda: mask_format(c), "partial": lambda: mask_partial(c), "email": lambda: mask_email(c), "cpf": lambda: mask_cpf(c)}
    return made[p.treatment]().alias(p.column)


def apply_policy(df: DataFrame, policies: Sequence[ColumnPolicy], role: str, key: bytes, open_roles: Sequence[str] = ("owner", "dpo"), pass_unlisted: bool = False) -> DataFrame:
    """What a role may see. A column without a policy is left out unless pass_unlisted."""
    if role in open_roles:
        return df
    by_name = {p.column: p for p in policies}
    columns = [treated(by_name[c], key) if c in by_name else F.col(c) if pass_unlisted else None for c in df.columns]
    return df.select(*[c for c in columns if c is not None])


def dynamic_view_sql(view: str, source: str, policies: Sequence[ColumnPolicy], key: bytes, variable: str = "role", open_roles: Sequence[str] = ("owner", "dpo")) -> str:
    """A temporary view that looks at a session variable each time it is queried; treatments as SQL."""
    roles = ", ".join(f"'{r}'" for r in open_roles)
    sql = {
        "none": lambda c: c, "sha256": lambda c: f"sha2(CAST({c} AS STRING), 256)", "hmac": lambda c: hmac_sql(c, key), "format": lambda c: f"mask(CAST({c} AS STRING), 'X', 'x', '9')", "drop": lambda c: "NULL",
        "partial": lambda c: f"concat(repeat('*', greatest(length({c}) - 2, 0)), right({c}, 2))", "email": lambda c: f"CASE WHEN {c} RLIKE '^[^@]+@[^@]+$' THEN concat(left({c}, 1), '***@', substring_index({c}, '@', -1)) WHEN {c} IS NOT NULL THEN '***' END",
        "cpf": lambda c: f"CASE WHEN length(regexp_replace({c}, '[^0-9]', '')) = 11 THEN concat('***.', substr(regexp_replace({c}, '[^0-9]', ''), 4, 3), '.', substr(regexp_replace({c}, '[^0-9]', ''), 7, 3), '-**') WHEN {c} IS NOT NULL THEN '***' END",
    }
    columns = ",\n  ".join(f"CASE WHEN {variable} IN ({roles}) THEN CAST({p.column} AS STRING) ELSE CAST({sql[p.treatment](p.column)} AS STRING) END AS {p.column}" if p.treatment != "none" else p.column for p in policies)
    return f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT\n  {columns}\nFROM {source}"


def tag_sql(table: str, policies: Sequence[ColumnPolicy]) -> list[str]:
    """Catalogue statements that record the classification of columns."""
    return [f"ALTER TABLE {table} ALTER COLUMN {p.column} SET TAGS ('level' = '{p.level.name.lower()}', 'personal' = '{str(p.personal).lower()}')" for p in policies]


#: What a value of a personal column looks like, by kind; tested on the whole value.
LOOKS = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "cpf": r"^\d{3}\.?\d{3}\.?\d{3}-?\d{2}$", "ip": r"^(\d{1,3}\.){3}\d{1,3}$", "phone": r"^\+?[\d ()-]{8,20}$", "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"}


@dataclass(frozen=True)
class ColumnProfile:
    """What a reviewer sees of a column: figures and masked samples, never a value."""

    column: str
    type: str
    rows: int
    nulls: int
    distinct: int
    looks: dict[str, float]
    samples: tuple[str, ...]


def column_profiles(df: DataFrame, samples: int = 3) -> list[ColumnProfile]:
    """Every column's figures from one aggregation: the share of values that look like a kind, and the most frequent masked forms."""
    figures = [F.count(F.lit(1)).alias("rows")]
    for i, (c, _) in enumerate(df.dtypes):
        text = F.col(f"`{c}`").cast("string")
        figures += [F.count_if(text.isNull()).alias(f"n{i}"), F.approx_count_distinct(text).alias(f"d{i}"), *[F.count_if(text.rlike(p)).alias(f"{k}{i}") for k, p in LOOKS.items()]]
    row = df.agg(*figures).first()
    forms = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), mask_format(F.left(F.col(f"`{c}`").cast("string"), F.lit(40))).alias("form")) for i, (c, _) in enumerate(df.dtypes)]))).filter("form is not null").groupBy("i", "form").count()
    best = forms.groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "form"))), 1, samples).alias("top"))
    shown = {r["i"]: tuple(x["form"] for x in r["top"]) for r in best.collect()}  # one row a column
    out = []
    for i, (c, kind) in enumerate(df.dtypes):
        values = row["rows"] - row[f"n{i}"]
        out.append(ColumnProfile(c, kind, row["rows"], row[f"n{i}"], row[f"d{i}"], {k: row[f"{k}{i}"] / values if values else 0.0 for k in LOOKS}, shown.get(i, ())))
    return out


#: Parts of column names that tell of personal data.
PERSONAL_NAMES = re.compile(r"(^|_)(name|login|email|mail|cpf|phone|address|ip|user|birth)(_|$)", re.IGNORECASE)


def personal_by_rules(profiles: Sequence[ColumnProfile], least: float = 0.5, by_name: bool = True) -> dict[str, str]:
    """column -> why it counts as personal: the kind that at least a share of its values look like, or its name."""
    out = {}
    for p in profiles:
        kind = max(p.looks, key=lambda k: p.looks[k]) if p.type == "string" else None
        if kind and p.looks[kind] >= least:
            out[p.column] = kind
        elif by_name and PERSONAL_NAMES.search(p.column):
            out[p.column] = "name"
    return out


def shred(keys: DataFrame, subject: str, gone: DataFrame) -> DataFrame:
    """The keys without those of some subjects: what was encrypted with these can't be read any more, wherever copies of it are."""
    return keys.join(gone.select(subject).distinct(), subject, "left_anti")


def decrypt_by_subject(df: DataFrame, subject: str, column: str, keys: DataFrame) -> DataFrame:
    """The column in clear for subjects whose key exists, else null."""
    book = keys.select(F.col(subject).alias("__s"), F.col("key_hex").alias("__k"))
    return df.join(book, F.col(subject) == F.col("__s"), "left").withColumn(column, decrypt(column, "__k")).drop("__s", "__k")
