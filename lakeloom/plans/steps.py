"""Steps that ask a model, behind one callable: optimise, route, rerank, compose. No model is part of this library.

A step runs over a table of prompts in Arrow batches on the executors. The stand-ins answer by rules, so that all phases can
run and be tested without a model.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from lakeloom.functions.similarity import json_in
from lakeloom.functions.text import STOP_WORDS

#: From a prompt to an answer: text, or blocks such as {"type": "text", "text": ...} and {"type": "thinking", "thinking": ...}.
Ask = Callable[[str], str | list]

VERBS = ["create", "use", "configure", "install", "build", "run", "write", "set", "make", "deploy", "compare", "explain"]


def filled(template: str, values: dict[str, str]) -> str:
    """A prompt with its {places} filled; places that are not given stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), template)


def read_blocks(answer) -> tuple[str | None, str | None]:
    """(text, thinking) of an answer: texts of several blocks are joined by line ends, the first thinking counts. Blocks are
    dicts or objects with such attributes; what is neither kind is passed over."""
    if answer is None or isinstance(answer, str):
        return answer, None
    get = lambda b, k: b.get(k) if isinstance(b, dict) else getattr(b, k, None)
    texts = [get(b, "text") for b in answer if get(b, "type") == "text" and get(b, "text")]
    thoughts = [get(b, "thinking") for b in answer if get(b, "type") == "thinking" and get(b, "thinking")]
    return "\n".join(texts) if texts else None, thoughts[0] if thoughts else None


def missing_keys(*keys: str) -> Callable[[str], list[str]]:
    """A check of answers or of what is asked: the names that its JSON object lacks."""

    def check(raw: str) -> list[str]:
        found = json_in(raw)
        have = json.loads(found) if found else {}
        return [k for k in keys if not isinstance(have, dict) or k not in have]

    return check


def ask_all(prompts: Column, ask: Ask, check: Callable[[str], list[str]] = lambda raw: [], retries: int = 2) -> Column:
    """struct(answer, faults, tries, thinking): an answer with faults is asked for again, up to `retries` times, naming them."""

    @pandas_udf("answer string, faults array<string>, tries int, thinking string")
    def run(batch: pd.Series) -> pd.DataFrame:
        out = []
        for prompt in batch:
            answer, faults, tries, thinking = None, ["null prompt"], 0, None
            while prompt is not None and tries <= retries and faults:
                again = "" if not tries else f"\n\nThe answer before lacked: {', '.join(faults)}. It was:\n{answer}"
                answer, thinking = read_blocks(ask(prompt + again))
                faults, tries = check(answer or ""), tries + 1
            out.append((answer, faults, tries, thinking))
        return pd.DataFrame(out, columns=["answer", "faults", "tries", "thinking"])

    return run(prompts)


def rule_optimiser(query: str) -> str:
    words = [w for w in re.findall(r"\w+", query.lower()) if w not in STOP_WORDS and w not in ("how", "what", "do", "i")]
    verbs = [w for w in words if w in VERBS]
    nouns = [w for w in words if w not in VERBS] or words
    return json.dumps({"query_analysis": {"original": query, "language": "zh" if re.search("[一-鿿]", query) else "en", "doc_set": [], "domain_nouns": nouns, "predicate_verbs": verbs}, "optimized_queries": [{"rank": 1, "query": query, "strategy": "original"}, {"rank": 2, "query": " ".join(nouns), "strategy": "nouns"}]}, ensure_ascii=False)


def rule_router(query: str) -> str:
    low = query.lower()
    scene = "comparison" if re.search(r"\bvs\b|compar|差异|对比", low) else "how_to" if re.search(r"\bhow\b|如何|怎么", low) else "concept_learning" if re.search(r"\bwhat\b|什么", low) else "fact_lookup"
    return json.dumps({"scene": scene, "confidence": 0.5, "ambiguity": 0.5, "coverage_need": 0.5, "reranker_threshold": 0.63})


def rule_composer(prompt: str) -> str:
    return prompt.strip()
