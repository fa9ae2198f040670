"""Model servers as injectable clients: a chat server over HTTP, a silent stub, and calls over rows."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .answerlog import Asker
from .web import Call, Policy, WebError

#: Answers of one batch.
TOLD_ROWS = 256


@dataclass(frozen=True)
class Response:
    text: str = ""
    thinking: str = ""
    error: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    duration_ms: int = 0


#: Fixed value: a header that public tunnels want to see before they pass a call on rather than answer with a page of their own.
TUNNEL = (("ngrok-skip-browser-warning", "true"),)


@dataclass(frozen=True)
class ChatServer:
    """POST /api/chat. An error is a value: after `retries` more tries, 2^n seconds apart, it is in the response."""

    model: str
    base_url: str = "http://localhost:11434"
    context_tokens: int = 8192
    temperature: float = 0.0
    seed: int = 7
    timeout: float = 300.0
    retries: int = 2
    think: bool | None = None
    wait: float = 1.0
    keep_alive: str = "30m"  # fixed value: how long the server holds the model after a call

    @property
    def name(self) -> str:
        return f"{self.model}@{self.context_tokens}"

    def payload(self, messages: list[dict], schema: dict | None = None, tools: list | None = None, temperature: float | None = None, seed: int | None = None) -> dict:
        options = {"num_ctx": self.context_tokens, "temperature": self.temperature if temperature is None else temperature, "seed": self.seed if seed is None else seed}
        optional = {"format": schema, "tools": tools or None, "think": self.think}
        return {"model": self.model, "messages": messages, "stream": False, "keep_alive": self.keep_alive, "options": options} | {k: v for k, v in optional.items() if v is not None}

    def _url(self, path: str) -> str:
        return self.base_url.rstrip("/") + path

    def chat(self, messages: list[dict], tools: list | None = None, schema: dict | None = None, temperature: float | None = None, seed: int | None = None) -> dict:
        """One turn: the server's message, or {"error": why}."""
        call = Call(self._url("/api/chat"), "POST", self.payload(messages, schema, tools, temperature, seed), TUNNEL)
        try:
            return Policy(self.retries + 1, self.wait, self.timeout).run(call, _object)
        except WebError as e:
            return {"error": str(e)}

    def complete(self, system: str, user: str, schema: dict | None = None) -> Response:
        began = time.monotonic()
        reply = self.chat([{"role": "system", "content": system}, {"role": "user", "content": user}], schema=schema)
        took, message = int(1000 * (time.monotonic() - began)), reply.get("message") or {}
        if reply.get("error"):
            return Response(error=str(reply["error"]), duration_ms=took)
        return Response(message.get("content") or "", message.get("thinking") or "", "", int(reply.get("prompt_eval_count") or 0), int(reply.get("eval_count") or 0), took)

    def _served(self) -> list[dict]:
        return Policy(1, 0, 30).run(Call(self._url("/api/tags"), headers=TUNNEL), _object).get("models") or []

    def _is_mine(self, entry: dict) -> bool:
        """The model by its whole name, or without its tag."""
        return self.model in (entry.get("name") or "", (entry.get("name") or "").partition(":")[0])

    def health(self) -> str:
        """Empty if the server has the model, else what is wrong."""
        try:
            served = self._served()
        except WebError as e:
            return f"no answer from {self.base_url}: {e}"
        if any(map(self._is_mine, served)):
            return ""
        offered = sorted(m["name"] for m in served if m.get("name"))
        return f"{self.model} is not among the models of {self.base_url}: {offered or 'it has none'}"

    def build(self) -> dict:
        """digest and quantisation of the model, as far as the server tells; answers of two builds are not one run."""
        try:
            found = next(filter(self._is_mine, self._served()), None)
        except WebError:
            found = None
        return {} if found is None else {"digest": found.get("digest", ""), "quantization": (found.get("details") or {}).get("quantization_level", "")}


def _object(data: bytes) -> dict:
    found = json.loads(data)
    if not isinstance(found, dict):
        raise ValueError("the server's answer is no object")
    return found


@dataclass(frozen=True)
class SilentStub:
    """Finds nothing."""

    name: str = "silent"

    def complete(self, system: str, user: str, schema: dict | None = None) -> Response:
        return Response(text='{"findings": []}')

    def chat(self, messages: list[dict], **_: object) -> dict:
        return {"message": {"content": '{"needed": "", "evidence": [], "reason": "", "verdict": "unsettled"}'}}


STUBS: dict[str, type] = {"silent": SilentStub}


def resolve_client(stub: str | None = None, model: str | None = None, dry_run: bool = False, **options):
    """None for a dry run, a stub by name, or a server."""
    if dry_run:
        return None
    if stub:
        return STUBS[stub]()
    if not model:
        raise ValueError("name a model, a stub, or a dry run")
    return ChatServer(model, **options)


def pack_asker(make_client: Callable[[], object], schema: dict, system: str | None = None) -> Asker:
    """packs (case_id, system, user) -> responses, one call a row. The partitions bound how many calls run at once. A system text that all packs have goes along once, not with each row."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        client = make_client()
        for batch in batches:
            for case_id, user, *own in zip(*(batch.column(c).to_pylist() for c in ("case_id", "user", *(["system"] if system is None else []))), strict=True):
                yield {"case_id": case_id, **vars(client.complete(own[0] if system is None else system, user, schema))}

    return Asker(lambda packs: packs.select("case_id", *(["system"] if system is None else []), "user"), answer)


def told_beside(wanted: DataFrame, asker: Asker, schema: str, beside: Sequence[str]) -> DataFrame:
    """As told, for an asker that gives an answer a row, in order: columns of the questions stay beside their answers."""
    rows, arrow, answer = asker.prepare(wanted), to_arrow_schema(StructType.fromDDL(schema)), asker.answer
    names, questions = arrow.names, rows.columns
    both = StructType([*StructType.fromDDL(schema), *(wanted.schema[c] for c in beside)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def seen() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, TOLD_ROWS):
                    waiting.append(whole.slice(at, TOLD_ROWS))
                    yield waiting[-1].select(questions)

        answers = answer(seen())
        for first in answers:  # a batch is waiting for its answers now
            batch = waiting.popleft()
            some = pa.RecordBatch.from_pylist([first, *islice(answers, batch.num_rows - 1)], arrow)
            yield pa.RecordBatch.from_arrays([*some.select(names).columns, *(batch.column(c) for c in beside)], names=both.names)

    return wanted.select(*dict.fromkeys([*questions, *beside])).mapInArrow(ask, both)


def told(wanted: DataFrame, asker: Asker, schema: str) -> DataFrame:
    """The answers as a DataFrame without a log. Write it before using it twice, or the calls repeat."""
    names, arrow, answer = [c.split()[0] for c in schema.split(", ")], to_arrow_schema(StructType.fromDDL(schema)), asker.answer

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing is seen of these answers before all are written, so they leave in batches: one a row costs more than a quick answer itself.
        rows = answer(batches)
        while some := list(islice(rows, TOLD_ROWS)):
            yield pa.RecordBatch.from_pylist(some, arrow).select(names)

    return asker.prepare(wanted).mapInArrow(ask, schema)
