"""python -m sievework.cli noise|prompt|ask|run|health ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .operators import noise
from .operators.profile import profile
from .operators.rows import ROW, with_row_id
from .plans import execute, planner, prompts
from .session import healthy, session
from .sources.tables import read_csv, write_csv


def _noise(a: argparse.Namespace) -> None:
    """For each level a noisy table and its log, then the profile of the clean table."""
    from pyspark.sql import functions as F

    spark = session()
    clean = with_row_id(read_csv(spark, a.input))
    for level in noise.LEVELS:
        noisy, log = noise.inject_all(clean, a.seed, noise.rates_for_level(level))
        write_csv(noisy.drop(ROW), f"{a.output_dir}/noisy_{level}.csv")
        write_csv(log, f"{a.output_dir}/injected_errors_{level}.csv")
        noise.counts_by_family(log).show()
    flat = profile(clean.drop(ROW)).withColumn("top_values", F.to_json("top_values"))
    write_csv(flat, f"{a.output_dir}/profile_clean.csv", single=True)


def _prompt(a: argparse.Namespace) -> None:
    df = with_row_id(read_csv(session(), a.dataset))
    print(prompts.build_prompt(df, a.approach, a.input_path, a.output_path, a.rows))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sievework")
    sub = p.add_subparsers(dest="command", required=True)
    n = sub.add_parser("noise")
    n.add_argument("--input", required=True), n.add_argument("--output_dir", required=True), n.add_argument("--seed", type=int, default=42)
    q = sub.add_parser("prompt")
    q.add_argument("--dataset", required=True), q.add_argument("--approach", choices=prompts.APPROACHES, default="simple")
    q.add_argument("--input_path", default="in"), q.add_argument("--output_path", default="out"), q.add_argument("--rows", type=int, default=5)
    k = sub.add_parser("ask")
    k.add_argument("prompt"), k.add_argument("--provider"), k.add_argument("--model")
    r = sub.add_parser("run")
    r.add_argument("script"), r.add_argument("--log"), r.add_argument("--timeout", type=float, default=120), r.add_argument("--working_dir")
    sub.add_parser("health")
    a = p.parse_args(argv)
    if a.command == "noise":
        Path(a.output_dir).mkdir(parents=True, exist_ok=True)
        _noise(a)
    elif a.command == "prompt":
        _prompt(a)
    elif a.command == "ask":
        base = planner.Settings.from_environment()
        print(planner.generate(a.prompt, planner.Settings(a.provider or base.provider, a.model or base.model, base.host, base.cloud_url, base.key)))
    elif a.command == "run":
        record = execute.run_and_log(a.script, a.log, a.timeout, a.working_dir) if a.log else execute.run_script(a.script, a.timeout, a.working_dir)
        print(json.dumps(record, indent=2, ensure_ascii=False))
        return 0 if record["success"] else 1
    else:
        print(json.dumps(healthy(session())))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
