"""Model inference as an adapter, prompts, backfill of missing translations, and the review export."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .split import sampled
from .validate import pending


@dataclass(frozen=True)
class Direction:
    source: str
    target: str
    source_name: str
    source_code: str
    target_name: str
    target_code: str
    comet_reliable: bool = True


# The directions and the prompt that models were tuned with.
DIRECTIONS = {
    "mar2bhb": Direction("mar", "bhb", "Marathi", "mr", "Bhili", "bhb", False),
    "bhb2mar": Direction("bhb", "mar", "Bhili", "bhb", "Marathi", "mr", True),
    "hin2bhb": Direction("hin", "bhb", "Hindi", "hi", "Bhili", "bhb", False),
    "bhb2hin": Direction("bhb", "hin", "Bhili", "bhb", "Hindi", "hi", True),
    "eng2bhb": Direction("eng", "bhb", "English", "en", "Bhili", "bhb", False),
    "bhb2eng": Direction("bhb", "eng", "Bhili", "bhb", "English", "en", True),
}
PROMPT = "You are a professional {lang_src} ({code_src}) to {lang_tgt} ({code_tgt}) translator. Your goal is to accurately convey the meaning and nuances of the original {lang_src} text while adhering to {lang_tgt} grammar, vocabulary, and cultural sensitivities. Produce only the {lang_tgt} translation, without any additional explanations or commentary. Please translate the following {lang_src} text into {lang_tgt}:"
# Language codes and names ("bod" is given as Bodo, whose own code is "brx").
LANGUAGES = {
    "eng": "English", "hin": "Hindi", "mar": "Marathi", "tam": "Tamil", "tel": "Telugu", "kan": "Kannada", "mal": "Malayalam", "guj": "Gujarati", "pan": "Punjabi", "ori": "Odia", "ben": "Bengali", "asm": "Assamese",
    "urd": "Urdu", "nep": "Nepali", "san": "Sanskrit", "snd": "Sindhi", "kas": "Kashmiri", "kok": "Konkani", "mai": "Maithili", "mni": "Manipuri", "doi": "Dogri", "sat": "Santali", "bod": "Bodo", "bhb": "Bhili",
}


def language(code: str) -> str:
    if code not in LANGUAGES:
        raise KeyError(code)
    return LANGUAGES[code]


def prompt(direction: str) -> str:
    d = DIRECTIONS[direction]
    return PROMPT.format(lang_src=d.source_name, code_src=d.source_code, lang_tgt=d.target_name, code_tgt=d.target_code)


def messages(system: str, user: Column, assistant: Column | None = None) -> Column:
    """A chat as an array of (role, content)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), *([] if assistant is None else [turn("assistant", assistant)]))


def training_chats(df: DataFrame, direction: str) -> DataFrame:
    d = DIRECTIONS[direction]
    return df.select(messages(prompt(direction), F.col(d.source), F.col(d.target)).alias("messages"))


@dataclass(frozen=True)
class Decoding:
    """How a model is to generate: beams (1 is greedy), new tokens at most, and sampling where the temperature is over 0."""

    beams: int = 1
    max_new_tokens: int = 512
    temperature: float = 0.0


# The two decodings that reports name, and the short prompt of the backfill.
DECODINGS = {"greedy": Decoding(1), "beam": Decoding(4)}
SHORT_PROMPT = "Translate the text below to {language}."

#: A translator takes a batch of chats and a decoding and gives as many translations; its factory is called once per worker.
Translator = Callable[[Sequence[list[dict[str, str]]], Decoding], Sequence[str]]


def echo() -> Translator:
    """A stand-in that gives back what the user says."""
    return lambda chats, decoding: [c[-1]["content"] for c in chats]


def short_prompt(code: str) -> str:
    return SHORT_PROMPT.format(language=language(code))


def chat(system: str, text: str) -> list[dict[str, str]]:
    """A chat as a translator gets it; without a system turn where there is none."""
    return [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": text}]


#: The models of a worker process, by the plan they are for.
_MODELS: dict[str, Translator] = {}


def _model(key: str, factory: Callable[[], Translator]) -> Translator:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = factory()
    return _MODELS[key]


def translated(df: DataFrame, source: str, factory: Callable[[], Translator] = echo, column: str = "prediction_raw", system: str = "", decoding: Decoding = Decoding(), batch: int = 16) -> DataFrame:
    """Adds the trimmed translation of each text that isn't blank; blank ones give an empty text and never reach the model."""
    key = uuid.uuid4().hex

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(key, factory)
        for own in batches:
            texts, out = [(x or "").strip() for x in own], [""] * len(own)
            todo = [i for i, x in enumerate(texts) if x]
            for a in range(0, len(todo), batch):
                part = todo[a : a + batch]
                for i, y in zip(part, model([chat(system, texts[i]) for i in part], decoding), strict=True):
                    out[i] = (y or "").strip()
            yield pd.Series(out)

    return df.withColumn(column, run(F.col(source)))


def backfilled(df: DataFrame, source: str, target: str, factory: Callable[[], Translator] = echo, system: str = "", decoding: Decoding = Decoding(), batch: int = 16) -> DataFrame:
    """Targets that are missing are filled; only such rows go through the model. The system turn is `short_prompt` of the language."""
    todo = pending(df, source, target)
    done = df.where(~F.coalesce((t.strip(t.text(F.col(source))) != "") & (t.strip(t.text(F.col(target))) == ""), F.lit(False)))
    filled = translated(todo, source, factory, "_new", system, decoding, batch).withColumn(target, F.col("_new")).drop("_new")
    return done.unionByName(filled)


def review_rows(df: DataFrame, sample: int | None = None, seed: int = 42, include_unedited: bool = False, keys: Sequence[str] = ("source", "prediction_raw")) -> DataFrame:
    """Rows for review with blank verdict columns: edited ones only, if not asked otherwise; sampled ones by edits, most first."""
    edits = F.coalesce(F.col("post_edits"), F.array().cast("array<array<string>>"))
    own = df if include_unedited else df.where(F.size(edits) > 0)
    own = own.withColumn("num_edits", F.size(edits))
    own = sampled(own, sample, list(keys), [F.desc("num_edits"), *map(F.col, keys)], seed)
    return own.select(F.coalesce("category", F.lit("")).alias("category"), "source", "reference", "prediction_raw", "prediction_final", t.changed(F.col("prediction_raw"), F.col("prediction_final")).alias("changed_by_postedit"), t.edits_text(edits).alias("post_edits"), "num_edits", F.lit("").alias("reviewer_verdict"), F.lit("").alias("reviewer_notes"))
