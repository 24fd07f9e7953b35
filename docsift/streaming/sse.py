"""Answer events as server-sent frames, and the request that keeps an exchange only when it is done."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from threading import Lock

from docsift.operators.service import Answer, AskError, Service


def frame(event: str, data: object) -> str:
    """One event; line breaks within the data are escaped by JSON."""
    return f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


class Busy(RuntimeError):
    """Another question is being answered."""


class Requests:
    """One question at a time; ``save`` gets the question and the answer once it is complete."""

    def __init__(self, service: Service | None, save: Callable[[str, Answer], None] = lambda question, answer: None):
        self.service, self.save, self._lock = service, save, Lock()

    def _begin(self) -> Service:
        if self.service is None:
            raise LookupError("no index is ready")
        if not self._lock.acquire(blocking=False):
            raise Busy("a question is being answered")
        return self.service

    def ask(self, question: str) -> dict:
        service = self._begin()
        try:
            answer = service.ask(question)
            self.save(question, answer)
            return answer.public()
        finally:
            self._lock.release()

    def ask_stream(self, question: str) -> Iterator[str]:
        """Frames of an answer; an error becomes an error frame, and then nothing is kept."""
        service = self._begin()
        try:
            for event, data in service.ask_stream(question):
                if isinstance(data, Answer):
                    self.save(question, data)
                    data = data.public()
                yield frame(event, data)
        except AskError as e:
            yield frame("error", {"message": str(e)})
        except Exception as e:  # noqa: BLE001  the reason may hold addresses or keys, so only its kind is told
            yield frame("error", {"message": type(e).__name__})
        finally:
            self._lock.release()

    def respond(self, question: str) -> tuple[int, dict]:
        """Status code and body of a request."""
        try:
            return 200, self.ask(question)
        except AskError as e:
            return 422, {"detail": str(e)}
        except Busy:
            return 429, {"detail": "busy"}
        except LookupError as e:
            return (503 if self.service is None else 404), {"detail": str(e)}
        except Exception as e:  # noqa: BLE001
            return 500, {"detail": type(e).__name__}
