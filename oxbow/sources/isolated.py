"""Reading files in a child process, so that a reader that hangs or dies costs its own file and no other.

A task keeps one child. It hands it a chunk of requests and takes the answers one by one, in order; so when no answer comes in time, or
the child is gone, the first request without an answer is the one to blame. That one becomes an error, and a new child goes on behind it.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

# Requests sent at once, and seconds that an answer may take.
CHUNK, LIMIT = 512, 120.0


def _serve(pipe, theirs, read: Callable) -> None:
    theirs.close()
    while True:
        try:
            chunk = pipe.recv()
        except (EOFError, OSError):
            return
        for request in chunk:
            pipe.send(read(*request))


class Helper:
    """`read(*request)` for many requests, each in the child; `failed(request, reason)` answers for one that had none."""

    def __init__(self, read: Callable, failed: Callable, limit: float = LIMIT, chunk: int = CHUNK):
        self.read, self.failed, self.limit, self.chunk = read, failed, limit, chunk
        self._child = self._pipe = None

    def _open(self):
        if self._child is None:
            context = multiprocessing.get_context("fork")  # readers that were registered in this process are there too
            self._pipe, theirs = context.Pipe()
            self._child = context.Process(target=_serve, args=(theirs, self._pipe, self.read), daemon=True)
            self._child.start()
            theirs.close()
        return self._pipe

    def close(self) -> str:
        """End the child; how it ended."""
        child, self._child = self._child, None
        if child is None:
            return "closed"
        child.join(0.2)
        code = child.exitcode
        if code is None:
            child.kill()
            child.join()
        self._pipe.close()
        return "still running" if code is None else f"exit code {code}"

    def answers(self, requests: Iterable[tuple]) -> Iterator:
        """One answer a request, in order."""
        requests = iter(requests)
        while todo := list(islice(requests, self.chunk)):
            while todo:
                done = 0
                try:
                    self._open().send(todo)
                    for _ in todo:
                        if not self._pipe.poll(self.limit):
                            raise TimeoutError
                        answer = self._pipe.recv()
                        done += 1
                        yield answer
                except TimeoutError:
                    self.close()
                    yield self.failed(todo[done], f"TimeoutError: no answer within {self.limit:g} s")
                    done += 1
                except (EOFError, OSError):
                    yield self.failed(todo[done], f"ReaderDied: {self.close()}")
                    done += 1
                todo = todo[done:]
