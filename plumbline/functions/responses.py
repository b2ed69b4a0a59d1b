"""Raw provider answers, as JSON in a column, to (text, top_logprobs, error).

A refusal is the empty text. Anything a provider should not send is the row's error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<token: string, logprob: double>"
#: Finish reasons that mean a refusal.
REFUSALS = ["SAFETY", "RECITATION", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "OTHER"]


def _answer(text: Column, logprobs: Column | None, error: Column) -> Column:
    probs = F.lit(None).cast(f"array<array<{TOKEN}>>") if logprobs is None else logprobs
    return F.struct(F.when(error.isNull(), text).alias("text"), F.when(error.isNull(), probs).alias("top_logprobs"), error.alias("error"))


def _single(choices: Column, text: Column) -> Column:
    n = F.coalesce(F.size(choices), F.lit(0))
    return F.when(n != 1, F.concat(F.lit("expected one choice, got "), n)).when(text.isNull(), "no text")


def chat_completion(raw: Column, logprobs: bool = False) -> Column:
    """Answers with choices[].message.content and, if asked for, choices[].logprobs.content[].top_logprobs."""
    r = F.from_json(raw, f"choices array<struct<message: struct<content: string>, logprobs: struct<content: array<struct<top_logprobs: array<{TOKEN}>>>>>>")
    one = F.try_element_at(r.choices, F.lit(1))
    text, given = one.message.content, one.logprobs.content
    error = _single(r.choices, text)
    if not logprobs:
        return _answer(text, None, error)
    return _answer(text, F.transform(given, lambda t: t.top_logprobs), F.coalesce(error, F.when(given.isNull(), "no logprobs")))


def text_completion(raw: Column, logprobs: bool = False) -> Column:
    """Answers with choices[].text and one probability a token in parallel lists."""
    r = F.from_json(raw, "choices array<struct<text: string, logprobs: struct<tokens: array<string>, token_logprobs: array<double>>>>")
    one = F.try_element_at(r.choices, F.lit(1))
    error = _single(r.choices, one.text)
    if not logprobs:
        return _answer(one.text, None, error)
    pairs = F.zip_with(one.logprobs.tokens, one.logprobs.token_logprobs, lambda t, p: F.array(F.struct(t.alias("token"), p.alias("logprob"))))
    whole = F.filter(pairs, lambda x: x[0].token.isNotNull() & x[0].logprob.isNotNull())
    return _answer(one.text, whole, F.coalesce(error, F.when(one.logprobs.tokens.isNull(), "no logprobs")))


def candidates(raw: Column) -> Column:
    """Answers with candidates[]; none, or one that was stopped for its content, is a refusal."""
    r = F.from_json(raw, "candidates array<struct<finish_reason: string, content: struct<parts: array<struct<text: string>>>>>")
    n = F.coalesce(F.size(r.candidates), F.lit(0))
    one = F.try_element_at(r.candidates, F.lit(1))
    refused = (n == 0) | F.coalesce(one.finish_reason.isin(REFUSALS), F.lit(False))
    text = F.when(refused, "").otherwise(F.try_element_at(one.content.parts, F.lit(1)).text)
    error = F.when(n > 1, F.concat(F.lit("expected one candidate, got "), n)).when(text.isNull(), "a candidate without content")
    return _answer(text, None, error)


def moderated(raw: Column) -> Column:
    """Answers with moderation results beside them; one that is flagged makes a refusal."""
    r = F.from_json(raw, "moderation_response struct<results: array<struct<flagged: boolean>>>, sut_response struct<completion_message: struct<content: struct<text: string>>>")
    flagged = F.coalesce(F.exists(r.moderation_response.results, lambda x: F.coalesce(x.flagged, F.lit(False))), F.lit(False))
    text = F.when(flagged, "").otherwise(r.sut_response.completion_message.content.text)
    return _answer(text, None, F.when(text.isNull(), "no text"))


def content_blocks(raw: Column) -> Column:
    """Answers with content[] of exactly one text block."""
    r = F.from_json(raw, "content array<struct<type: string, text: string>>")
    one = F.try_element_at(r.content, F.lit(1))
    error = F.when(F.coalesce(F.size(r.content), F.lit(0)) != 1, "expected one block").when(one.type != "text", "not a text block").when(one.text.isNull(), "no text")
    return _answer(one.text, None, error)


def envelope(kind: str, data: Column) -> Column:
    """A typed JSON envelope: {class_name, data}."""
    return F.to_json(F.struct(F.lit(kind).alias("class_name"), data.alias("data")))


def opened(raw: Column, kind: str, schema: str) -> Column:
    """The data of an envelope of this kind; another kind is an error."""
    r = F.from_json(raw, f"class_name string, data struct<{schema}>")
    return F.when(r.class_name == kind, r.data).otherwise(F.raise_error(F.concat(F.lit(f"expected {kind}, got "), F.coalesce(r.class_name, F.lit("nothing")))).cast(f"struct<{schema}>"))
