"""Labelled samples for training: synthetic values in sentences, and a split that keeps a value on one side.

Values are made by rule from seeded draws; words come from short lists given as parameters.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions.fixed import MODEL_LABELS

_GIVEN = "Ana Boris Clara Dinesh Elif Farid Greta Hiro Ines Jonas Kofi Lena".split()
_FAMILY = "Abara Berg Castro Dutt Evans Fischer Grau Haddad Ito Jansen Kaya Lopez".split()
_STREETS = "Oak Maple River Hill Lake Cedar Station Church".split()
_PLAIN = "the meeting moved to noon;please water the plants;our team won the match;lunch is on the second floor;a new bridge opened;reading is fun;the train was late again;save the file first;clouds over the bay;thanks for the quick reply".split(";")
_WRAPS = "{};contact: {};value {} on file;see {} for details;({});entry - {}".split(";")


def check_digit(body: str) -> str:
    """The digit that makes a number valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _letters(r: random.Random, n: int, of: str = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") -> str:
    return "".join(r.choice(of) for _ in range(n))


def _card(r: random.Random) -> str:
    body = r.choice("45") + _digits(r, 14)
    n = body + check_digit(body)
    return n if r.random() < 0.5 else " ".join(n[i : i + 4] for i in range(0, 16, 4))


VALUES: dict[str, Callable[[random.Random], str]] = {
    "EMAIL": lambda r: f"{r.choice(_GIVEN).lower()}.{r.choice(_FAMILY).lower()}{r.randrange(100)}@{r.choice(('mailbox', 'post', 'inbox'))}{r.randrange(9)}.net",
    "PHONE": lambda r: f"+{r.randrange(1, 99)} {_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}" if r.random() < 0.5 else f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}",
    "CREDIT_CARD": _card,
    "NAME": lambda r: f"{r.choice(_GIVEN)} {r.choice(_FAMILY)}",
    "ADDRESS": lambda r: f"{r.randrange(1, 999)} {r.choice(_STREETS)} {r.choice(('St', 'Ave', 'Blvd'))}, Town {_digits(r, 5)}",
    "PASSWORD": lambda r: _letters(r, r.randrange(8, 14)) + r.choice("!#$%&*") + _digits(r, 2),
    "USERNAME": lambda r: f"{r.choice(_GIVEN).lower()}_{_digits(r, 3)}",
    "API_KEY": lambda r: f"{r.choice(('sk', 'pk'))}_live_{_letters(r, 24)}",
    "AUTH_TOKEN": lambda r: f"Bearer {_letters(r, 32)}",
    "SSN": lambda r: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}",
    "MEDICAL_ID": lambda r: f"MRN-{_digits(r, 8)}",
    "BANK_ACCOUNT": lambda r: f"account number {_digits(r, 12)}",
    "FINANCIAL_DATA": lambda r: f"${r.randrange(1, 999)},{_digits(r, 3)}.00",
    "DATE_OF_BIRTH": lambda r: f"{r.randrange(1, 13):02}/{r.randrange(1, 29):02}/{r.randrange(1940, 2010)}",
    "NONE": lambda r: f"{r.choice(_PLAIN)} {_letters(r, 4, 'aeiou')}",
}


def generate_samples(spark: SparkSession, per_label: int = 320, seed: int = 7, labels: tuple[str, ...] = MODEL_LABELS, tasks: int | None = None) -> DataFrame:
    """``(id, text, label, value)``: each row depends on its id and the seed alone, so partitions don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                label, r = labels[i % len(labels)], random.Random(f"{seed}:{i}")
                value = VALUES[label](r)
                rows.append({"id": i, "text": r.choice(_WRAPS).format(value), "label": label, "value": value})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("text", pa.string()), ("label", pa.string()), ("value", pa.string())]))

    return spark.range(0, per_label * len(labels), 1, tasks).mapInArrow(run, "id long, text string, label string, value string")


def split_of(key: Column, train: int = 8, validate: int = 1, parts: int = 10) -> Column:
    """``train``, ``val`` or ``test`` by a hash of the value, so that equal values are on one side."""
    h = F.pmod(F.xxhash64(key), F.lit(parts))
    return F.when(h < train, "train").when(h < train + validate, "val").otherwise("test")


def value_key(text: Column, label: Column) -> Column:
    """What must not be on two sides: the digits of numbers, else the longest word in lower case."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    words = F.filter(F.split(F.lower(text), r"[\s():,]+"), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    return F.concat_ws(":", label, F.when(F.length(digits) >= 6, digits).otherwise(F.coalesce(longest, F.lit(""))))


#: Words of the six kinds of intent.
INTENTS = {
    "click": "click press tap open choose".split(), "type": "type enter write fill input".split(), "scroll": "scroll move slide page go".split(),
    "search": "search find look locate query".split(), "read": "read show tell describe explain".split(), "submit": "submit send confirm finish save".split(),
}
_OBJECTS = "the form;the first link;a button;my name;the page down;the price;this article;the menu;the order;the settings".split(";")


def generate_intents(spark: SparkSession, per_label: int = 350, seed: int = 7) -> DataFrame:
    """``(id, text, label)`` of short instructions."""
    labels = tuple(INTENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                label, r = labels[i % len(labels)], random.Random(f"intent:{seed}:{i}")
                rows.append({"id": i, "text": f"{r.choice(('', 'please ', 'now '))}{r.choice(INTENTS[label])} {r.choice(_OBJECTS)}", "label": label})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("text", pa.string()), ("label", pa.string())]))

    return spark.range(per_label * len(labels)).mapInArrow(run, "id long, text string, label string")


def generate_crops(spark: SparkSession, n: int = 200, seed: int = 7, width: int = 96, height: int = 48) -> DataFrame:
    """``(id, sensitive, pixels)``: gray crops, one in three with rows of marks that look like masked digits."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                image, hot = rng.normal(200, 15, (height, width)), i % 3 == 0
                if hot:
                    for k in range(4):
                        image[16:32, 6 + 22 * k : 22 + 22 * k : 4] = 20
                else:
                    y = int(rng.integers(4, height - 8))
                    image[y : y + 2, 4 : int(rng.integers(20, width - 4))] = 60
                rows.append({"id": i, "sensitive": int(hot), "pixels": np.clip(image, 0, 255).astype(np.uint8).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("sensitive", pa.int32()), ("pixels", pa.binary())]))

    return spark.range(n).mapInArrow(run, "id long, sensitive int, pixels binary")
