"""Language models behind a batch function: prompts in, JSON texts out.

A client is a plain function from a prompt to a response; it is called on executors, once for each row, with retries.
`http_client` makes one for a local chat server. What comes back is read by native expressions.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.jsonx import first_array, strip_code_fences

TIMEOUT, ATTEMPTS = 300, 5


def http_client(model: str, base_url: str, timeout: int = TIMEOUT) -> Callable[[str], str]:
    def ask(prompt: str) -> str:
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "format": "json", "stream": False}).encode()
        request = urllib.request.Request(f"{base_url}/api/chat", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)["message"]["content"]

    return ask


def ask(prompts: DataFrame, client: Callable[[str], str], attempts: int = ATTEMPTS) -> DataFrame:
    """Adds raw (null after so many failed attempts in a row) and response: the first list in it as JSON text, null if there is none."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, raw string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prompt in batch["prompt"]:
                answer = None
                for _ in range(attempts):
                    try:
                        answer = client(prompt)
                        break
                    except (OSError, ValueError, KeyError, RuntimeError):
                        continue
                out.append(answer)
            yield batch.assign(raw=out)

    return prompts.mapInPandas(run, schema).withColumn("response", first_array(strip_code_fences(F.col("raw"))))
