"""python -m tessera serve | version: one JSON request a line on stdin, {"id", "tool", "arguments"}, one answer a line."""

from __future__ import annotations

import argparse
import json
import sys
from typing import TextIO

from . import __version__
from .errors import EngineError
from .prompts import PROMPTS, render


def serve(engine, requests: TextIO, answers: TextIO) -> None:
    for line in requests:
        if not line.strip():
            continue
        answer: dict = {"id": None}
        try:
            given = json.loads(line)
            answer["id"] = given.get("id")
            if "prompt" in given:
                answer["result"] = render(given["prompt"], **given.get("arguments", {}))
            elif given.get("tool") == "list":
                answer["result"] = {"tools": sorted(engine.tools()), "prompts": {k: v[0] for k, v in PROMPTS.items()}}
            else:
                answer["result"] = engine.call(given["tool"], given.get("arguments", {}))
        except EngineError as e:
            answer["error"] = {"message": str(e), "user_error": e.user_error, "retryable": e.retryable}
        except (KeyError, TypeError, ValueError) as e:
            answer["error"] = {"message": f"bad request: {e}", "user_error": True, "retryable": False}
        print(json.dumps(answer, default=str), file=answers, flush=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("command", choices=["serve", "version"], nargs="?", default="serve")
    parser.add_argument("--config")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    from .client import Engine
    from .config import Config
    from .session import build_session

    serve(Engine(build_session(), Config.load(args.config)), sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
