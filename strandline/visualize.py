"""``python -m strandline.visualize SET [--to FOLDER --schema FILE] [--rows N]``: shows a saved sample set, or writes it for a viewer.

The schema is a YAML file: a column is ``time`` or a list of components (kind, static, indices).
"""

from __future__ import annotations

import argparse

from .plans.dataset import SampleSet
from .plans.sinks import Component, ViewerSink, log_to_console
from .session import session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("set")
    parser.add_argument("--to")
    parser.add_argument("--schema")
    parser.add_argument("--recording", nargs="+", default=["input_id"])
    parser.add_argument("--rows", type=int, default=20)
    given = parser.parse_args(arguments)
    if (given.to is None) != (given.schema is None):
        parser.error("--to and --schema go together")
    samples = SampleSet.load(session("visualize"), given.set)
    if given.to is None:
        log_to_console(samples.samples.orderBy("sample_idx"), given.rows)
        return
    import yaml

    with open(given.schema, encoding="utf-8") as f:
        schema = {c: v if v == "time" else [Component(**x) for x in v] for c, v in yaml.safe_load(f).items()}
    ViewerSink(schema, given.recording).log(samples.samples, given.to)


if __name__ == "__main__":
    main()
