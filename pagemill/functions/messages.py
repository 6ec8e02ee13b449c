"""Chat messages and the prompts sent to a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed_values as fixed
from pagemill.functions.draws import choice, coin
from pagemill.functions.text import render, strip_improved_lead

STAGES = ("author", "request", "response")
CATEGORIES = {
    "author": [],
    "request": list(fixed.REQUEST_CATEGORIES),
    "response": [*fixed.REQUEST_CATEGORIES, fixed.REFINE_CATEGORY],
}
REQUEST_PROMPTS = {
    "WI_all": (fixed.WI_ALL_PROMPT, fixed.WI_WORDS),
    "WI_part": (fixed.WI_PART_PROMPT, fixed.WI_WORDS),
    "WR_all": (fixed.WR_ALL_PROMPT, fixed.WR_WORDS),
    "WR_part": (fixed.WR_PART_PROMPT, fixed.WR_WORDS),
}


def author_prompt(web: Column) -> Column:
    return render(fixed.AUTHOR_PROMPT, web=web)


def request_prompt(category: str, web: Column, author: Column, key: Column, seed: str = "") -> Column:
    """The word and the length limit are drawn once per row."""
    template, words = REQUEST_PROMPTS[category]
    return render(
        template,
        web=web,
        author=author,
        word=choice(words, f"{seed}word", key),
        len_limit=choice(fixed.LEN_LIMITS, f"{seed}len_limit", key),
    )


def wi_response_prompt(web: Column, request: Column) -> Column:
    return render(fixed.WI_RESPONSE_PROMPT, web=web, request=request)


def wr_response_prompt(request: Column) -> Column:
    return request


def refine_prompt(web: Column, request: Column, response: Column) -> Column:
    return render(fixed.WR_REFINE_PROMPT, web=web, request=request, answer=response)


def stage_prompt(
    stage: str,
    *,
    category: Column | None = None,
    web: Column | None = None,
    author: Column | None = None,
    request: Column | None = None,
    response: Column | None = None,
    key: Column | None = None,
    seed: str = "",
) -> Column:
    """The prompt of a row, from its category column: all categories of a stage
    run in one job. A row with an unknown category fails the job.

    ``response`` may be left out where no row is of the refine category.
    """
    if stage not in STAGES:
        raise ValueError(f"stage {stage!r} is not one of {STAGES}")
    needed = {"author": [web], "request": [category, web, author, key], "response": [category, web, request]}
    if any(column is None for column in needed[stage]):
        raise ValueError(f"the {stage} stage lacks a column it needs")
    if stage == "author":
        return author_prompt(web)
    if stage == "request":
        options = {c: request_prompt(c, web, author, key, seed) for c in fixed.REQUEST_CATEGORIES}
    else:
        options = {
            c: wi_response_prompt(web, request) if c.startswith("WI") else wr_response_prompt(request)
            for c in fixed.REQUEST_CATEGORIES
        }
        if response is not None:
            options[fixed.REFINE_CATEGORY] = refine_prompt(web, request, response)
    chain = F
    for name, prompt in options.items():
        chain = chain.when(category == name, prompt)
    unknown = F.concat(F.lit("no prompt for category "), F.coalesce(category, F.lit("null")))
    return chain.otherwise(F.raise_error(unknown).cast("string"))


def message(role: str, content: Column) -> Column:
    return F.struct(content.alias("content"), F.lit(role).alias("role"))


def api_messages(prompt: Column) -> Column:
    return F.array(message("system", F.lit(fixed.SYSTEM_MESSAGE)), message("user", prompt))


def chat_text(prompt: Column, model: str) -> Column:
    """One templated string for a local batch model; Llama 3 models only."""
    if "llama-3" not in model.lower():
        raise ValueError(f"no chat template for model {model!r}")
    return render(fixed.LLAMA3_CHAT, prompt=prompt)


def wi_messages(web: Column, request: Column, response: Column, key: Column, seed: str = "") -> Column:
    """The page is part of the user turn, on either side of the request."""
    gap = F.lit("\n\n")
    user = F.when(coin(f"{seed}side", key), F.concat(request, gap, web)).otherwise(F.concat(web, gap, request))
    return F.array(message("user", user), message("assistant", response))


def wr_messages(request: Column, response: Column) -> Column:
    return F.array(message("user", request), message("assistant", strip_improved_lead(response)))
