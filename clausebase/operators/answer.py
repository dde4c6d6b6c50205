"""Grounded answers: retrieval, the message, a model behind a hook, and citations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.text import user_message
from .retrieval import citations

# fixed value: what is said when nothing was retrieved
REFUSAL = "No relevant excerpts were found in the indexed knowledge base for this question, so it can't be answered from the documents."

Message = dict[str, str]
Model = Callable[[Sequence[Message]], str]


@dataclass(frozen=True)
class Answer:
    text: str
    mode: str
    citations: DataFrame
    history: list[Message] = field(default_factory=list)


def answer(question: str, hits: DataFrame, mode: str, model: Model, history: Sequence[Message] = ()) -> Answer:
    """One citation for each chunk supplied; without chunks the fixed refusal, and the model is not called."""
    cited = citations(hits)
    if hits.isEmpty():
        return Answer(REFUSAL, mode, cited, list(history))
    asked = {"role": "user", "content": user_message(question, hits).first()["message"]}
    text = model([*history, asked])
    return Answer(text, mode, cited, [*history, {"role": "user", "content": question}, {"role": "assistant", "content": text}])
