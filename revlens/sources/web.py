"""HTTP calls: whatever can go wrong with one is one exception, and one policy says when and how a call is repeated."""

from __future__ import annotations

import hashlib
import http.client
import io
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

T = TypeVar("T")
DETAIL = 500


class WebError(Exception):
    """status is None if no whole answer came: a refused or dropped connection, a timeout, half an answer, or one that can't be read."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


@dataclass(frozen=True)
class Call:
    url: str
    method: str = "GET"
    body: object = None
    headers: tuple[tuple[str, str], ...] = ()

    def send(self, timeout: float, read: Callable[[bytes], T] = bytes) -> T:
        """One try. `read` turns the answer's bytes into a value; a ValueError of it is a failed call."""
        data = None if self.body is None else json.dumps(self.body).encode()
        kind = {} if data is None else {"Content-Type": "application/json"}
        request = urllib.request.Request(self.url, data, kind | dict(self.headers), method=self.method)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return read(answer.read())
        except urllib.error.HTTPError as e:
            raise WebError(f"HTTPError {e.code}: {_rest(e)}", e.code, _after(e)) from e
        except (OSError, http.client.HTTPException, ValueError) as e:
            raise WebError(f"{type(e).__name__}: {e}") from e


def _after(error: urllib.error.HTTPError) -> float | None:
    """How long the server asks callers to wait."""
    told = error.headers.get("Retry-After", "") if error.headers else ""
    return float(told) if told.replace(".", "", 1).isdigit() else None


def _rest(error: urllib.error.HTTPError) -> str:
    """What a refusal says; its connection may drop as well."""
    try:
        return error.read().decode("utf-8", "replace")[:DETAIL]
    except (OSError, http.client.HTTPException):
        return ""


@dataclass(frozen=True)
class Policy:
    """At most `tries` tries; after the n-th (from 0) that failed, `wait` * 2^n seconds, or as long as the server asks for."""

    tries: int
    wait: float
    timeout: float

    def run(self, call: Call, read: Callable[[bytes], T] = bytes, again: Callable[[WebError], bool] = lambda _: True) -> T:
        for n in range(max(1, self.tries)):
            try:
                return call.send(self.timeout, read)
            except WebError as e:
                if n + 1 >= self.tries or not again(e):
                    raise
                time.sleep(self.wait * 2**n if e.retry_after is None else e.retry_after)
        raise AssertionError("unreachable")


class Stream(io.RawIOBase):
    """A GET's body as a file that is read once, from front to back. A connection that drops is taken up where it broke off (by range, or by passing over what was read if the
    server has no ranges), at most `tries` times without progress. A body that turns out to be another one than before is a WebError: by its validator, or by its digest
    up to the place."""

    def __init__(self, call: Call, policy: Policy):
        super().__init__()
        self.call, self.policy, self.at = call, policy, 0
        self._digest, self._tag, self._answer = hashlib.sha256(), None, None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        for n in range(max(1, self.policy.tries)):
            wait = self.policy.wait * 2**n
            try:
                if self._answer is None:
                    self._answer = self._open()
                data = self._answer.read(len(buffer))
                if not data and self._answer.length:
                    raise http.client.IncompleteRead(data, self._answer.length)
                buffer[: len(data)] = data
                self._digest.update(data)
                self.at += len(data)
                return len(data)
            except urllib.error.HTTPError as e:
                if n + 1 >= self.policy.tries or not (e.code == 429 or e.code >= 500):
                    raise WebError(f"HTTPError {e.code}: {_rest(e)}", e.code) from e
                wait = wait if (told := _after(e)) is None else told
            except (OSError, http.client.HTTPException) as e:
                if n + 1 >= self.policy.tries:
                    raise WebError(f"{type(e).__name__}: {e}") from e
            self._drop()
            time.sleep(wait)
        raise AssertionError("unreachable")

    def _open(self) -> http.client.HTTPResponse:
        """The body from where reading stands."""
        headers = dict(self.call.headers) | {"Accept-Encoding": "identity"}
        if self.at:
            headers |= {"Range": f"bytes={self.at}-"} | ({"If-Range": self._tag} if self._tag else {})
        answer = urllib.request.urlopen(urllib.request.Request(self.call.url, headers=headers), timeout=self.policy.timeout)
        tag = answer.headers.get("ETag")
        if self._tag and tag != self._tag:
            raise WebError(f"{self.call.url}: its content has changed while it was read")
        self._tag = tag if tag and not tag.startswith("W/") else None
        if self.at and answer.status != 206:
            seen, left = hashlib.sha256(), self.at
            while left and (data := answer.read(min(left, 1 << 20))):
                seen.update(data)
                left -= len(data)
            if left:
                raise http.client.IncompleteRead(b"", left)
            if seen.digest() != self._digest.digest():
                raise WebError(f"{self.call.url}: its content has changed while it was read")
        return answer

    def _drop(self) -> None:
        if self._answer is not None:
            self._answer.close()
        self._answer = None

    def close(self) -> None:
        self._drop()
        super().close()
