"""A ledger of index jobs: resumed, tried again, summed up."""
import json

from pyspark.sql import functions as F

from tabscout.functions.vectors import hash_encode
from tabscout.plans import index_job, pending_runs

DOCS = "database_name string, table_id string, `table` array<array<string>>"


def documents(spark, n):
    return spark.createDataFrame([("d", f"t{i}", [["a"], [str(i)]]) for i in range(n)] + [("d", "x", [["a"]])], DOCS)


def test_second_job_takes_up_what_is_open(spark, tmp_path):
    ledger, path = str(tmp_path / "ledger"), str(tmp_path / "vectors")
    sets = {"one": documents(spark, 2), "two": documents(spark, 3)}
    works = [False]

    def moody(text):
        if not works[0]:
            raise ValueError("out of order")
        return hash_encode(text, 8)

    models = {"moody": moody, "plain": lambda text: hash_encode(text, 16), "never": hash_encode}
    first = pending_runs.run_pending(spark, ledger, sets, models, path, skip=["never"], job="a")
    assert sorted((r.dataset, r.model, r.event) for r in first.collect() if r.event != "claimed") == [
        ("one", "moody", "failed"), ("one", "plain", "done"), ("two", "moody", "failed"), ("two", "plain", "done")]
    pending_runs._note(spark, ledger, "two", "moody", "claimed", "lost")  # a job that never came back
    combos = pending_runs.combinations(spark, ledger, list(sets), list(models), ["never"])
    state = {(r.dataset, r.model): (r.state, r.reason, r.embeddings_count) for r in combos.collect()}
    assert state["one", "moody"] == ("failed", "out of order", None) and state["two", "moody"][0] == "claimed"
    assert state["two", "plain"] == ("done", None, 3) and state["one", "never"][0] == "skipped model"
    works[0] = True
    second = pending_runs.run_pending(spark, ledger, sets, models, path, skip=["never"], job="b")
    assert sorted((r.dataset, r.model, r.event) for r in second.collect() if r.event != "claimed") == [("one", "moody", "done"), ("two", "moody", "done")]
    assert pending_runs.run_pending(spark, ledger, sets, models, path, skip=["never"], job="c").count() == 0
    combos = pending_runs.combinations(spark, ledger, list(sets), list(models), ["never"])
    pending_runs.write_summary(combos, str(tmp_path / "summary"))
    (file,) = (tmp_path / "summary").glob("*.json")
    told = json.loads(file.read_text())
    assert (told["total_combinations"], told["completed"], told["failed"], told["embeddings"]) == (4, 4, 0, 10)
    assert len(told["results"]) == 4 and told["timestamp"]


def test_full_run_record(spark, tmp_path):
    r = index_job.build_index(documents(spark, 3), "d", "m", str(tmp_path / "v"), model_path="/models/m").first()
    assert r.encoding_inference_time_seconds > 0 and r.indexing_time_seconds > 0 and r.index_size_bytes > 100
    assert abs(r.total_time_seconds - r.encoding_inference_time_seconds - r.indexing_time_seconds) < 0.05
    assert r.timestamp_start <= r.timestamp_end and (r.model_path, r.device, r.gpu_available) == ("/models/m", "CPU", False)
