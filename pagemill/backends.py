"""Deterministic model backends for tests and offline runs."""

from __future__ import annotations

import hashlib
import json
import re


def stub_reply(prompt: str) -> str:
    """A reply that depends on the prompt alone: eight words from its MD5.

    The first hex digit picks a form, so that refusals, lead-ins, quotes and
    improved answers all occur.
    """
    digest = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    words = " ".join(re.findall("....", digest))
    forms = {
        "0": f"I'm sorry, {words}",
        "1": f"Here is the reply:\n\n{words}",
        "2": f'"{words}"',
        "3": f"Here's the Improved Answer:\n\n---\n{words}\n\n---",
        "4": f"Here's {words}",
        "5": f"The improved answer:\n\n---\n{words}\n\n---",
    }
    return forms.get(digest[0], words)


def stub(prompts: list[str]) -> list[str | None]:
    return [stub_reply(p) for p in prompts]


def option_stub(prompts: list[str], **options) -> list[str | None]:
    """As ``stub``, with the options that the backend was given behind each reply."""
    shown = json.dumps(options, sort_keys=True)
    return [f"{stub_reply(p)} {shown}" for p in prompts]


def failing_stub(prompts: list[str]) -> list[str | None]:
    """As ``stub``, but prompts whose MD5 starts with f fail every time."""
    return [None if hashlib.md5(p.encode("utf-8")).hexdigest()[0] == "f" else stub_reply(p) for p in prompts]
