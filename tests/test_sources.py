import os

import pytest
from pyspark.sql import functions as F

from earshot import presets
from earshot.operators import records as R
from earshot.sources import readers, sinks


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_path_corpora(spark, tmp_path):
    root = str(tmp_path)
    for p in ("Yes/ab12_nohash_0.wav", "yes/cd34_nohash_1.wav", "_background_noise_/x.wav", "yes/readme.txt"):
        write(root, p, "x")
    got = readers.path_corpus(spark, root).collect()
    assert sorted((r.label, r.speaker) for r in got) == [("yes", "ab12"), ("yes", "cd34")]
    takes = str(tmp_path / "takes")
    for p in ("wake/emp1/t1/ch07.wav", "wake/emp1/t1/ch01.wav", "wake/room_background/t1/ch07.wav", "wake/emp2/t9/ch07.wav"):
        write(takes, p, "x")
    got = readers.take_corpus(spark, takes, "ch07").collect()
    assert sorted((r.label, r.speaker, r.take) for r in got) == [("wake", "emp1", "t1"), ("wake", "emp2", "t9")]
    support = readers.support_set(spark, takes, [".wav"]).groupBy("label").count().collect()
    assert [(r.label, r["count"]) for r in support] == [("wake", 4)]


def test_label_file_and_split_csvs(spark, tmp_path):
    path = write(str(tmp_path), "label.txt", "CF0005_0001   Hey\nCF0006_0002\tlight\n\n")
    assert [tuple(r) for r in readers.label_file(spark, path).orderBy("file").collect()] == [
        ("Hey Siri", "wav/CF0005/CF0005_0001.wav", "CF0005"), ("light", "wav/CF0006/CF0006_0002.wav", "CF0006")]
    csv = write(str(tmp_path), "en_train.csv", "X,WORD,LINK,SPEAKER\n1,cat,a.opus,s1\n2,dog,b.opus,s2\n")
    rows = readers.split_csvs(spark, {"training": csv}).collect()
    assert [(r.label, r.file, r.speaker, r.split) for r in rows] == [("cat", "a.opus", "s1", "training"), ("dog", "b.opus", "s2", "training")]


def test_lexicon_and_word_lists(spark, tmp_path):
    path = write(str(tmp_path), "dict", ";;; comment\n# also\nCAF\xc9  K AH0 F EY1\nread  R IY1 D\nread(2)  R EH1 D\nlonely\n", "latin-1")
    got = [(r.word, r.pron_no, list(r.phones)) for r in readers.lexicon(spark, path).orderBy("word", "pron_no").collect()]
    assert got == [("CAF\xc9", 1, ["K", "AH", "F", "EY"]), ("READ", 1, ["R", "IY", "D"]), ("READ", 2, ["R", "EH", "D"])]
    words = write(str(tmp_path), "words", "# c\nfoo, bar baz\nfoo\n")
    assert sorted(r.word for r in readers.word_list(spark, words).collect()) == ["BAR", "BAZ", "FOO"]
    una = write(str(tmp_path), "unaligned.txt", "1-2-3 reason\n\n1-2-4\n")
    assert sorted(r.utt_id for r in readers.unaligned_utterances(spark, una).collect()) == ["1-2-3", "1-2-4"]
    assert spark.range(1).select(readers.inline_words(F.lit("a, b,,c")).alias("w")).first().w == ["A", "B", "C"]


GRID = '''File type = "ooTextFile"
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        xmin = 0
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "say ""hi"""
        intervals [2]:
            xmin = 0.5
            xmax = 1
            text = ""
    item [2]:
        name = "phones"
        intervals [1]:
            xmin = 0
            xmax = 0.25
            text = "HH"
'''


def test_tier_files_and_errors(spark, tmp_path):
    root = str(tmp_path)
    write(root, "a/12-34-0001.TextGrid", GRID)
    write(root, "a/12-34-0002.TextGrid", GRID.replace('"phones"', '"other"'))
    rows = readers.tier_files(spark, root).collect()
    good = sorted((r.tier, r.pos, r.start, r.end, r.text) for r in rows if r.error is None)
    assert good == [("phones", 1, 0.0, 0.25, "HH"), ("words", 1, 0.0, 0.5, 'say "hi"'), ("words", 2, 0.5, 1.0, "")]
    assert [(r.utt_id, r.speaker_id, r.chapter_id) for r in rows if r.error] == [("12-34-0002", "12", "34")]


def test_manifest_round_trip(spark, tmp_path):
    rows = [("camy_phoneme_similar", "camy", "train-clean", f"1-2-{i}", str(i % 3), "2", 0.5, 1.25, 0.75, ["HEY"], ["K", "AE1"], ["K", "AE"],
             0.5, 2, "word_1_gram", "", "train" if i % 2 else "val") for i in range(6)]
    df = spark.createDataFrame(rows, "category string, target string, source_split string, source_utt_id string, speaker_id string, chapter_id string, "
                               "start_sec double, end_sec double, duration_sec double, words array<string>, phones array<string>, normalized_phones array<string>, "
                               "similarity double, edit_distance int, matched_rule string, blacklist_flag string, split string")
    folder = str(tmp_path / "manifests")
    manifest = sinks.manifest_rows(df)
    sinks.write_manifests(manifest, folder)
    text = spark.read.option("header", True).csv(folder + "/all")
    assert text.columns == presets.MANIFEST_FIELDS and text.count() == 6
    assert text.first().similarity == "0.5000" and text.first().phones == "K AE1"
    back = readers.hard_negative_manifests(spark, "/data", {"training": folder + "/by_split/split=train", "validation": folder + "/by_split/split=val"})
    assert {(r.split, r["count"]) for r in back.groupBy("split").count().collect()} == {("training", 3), ("validation", 3)}
    first = back.first()
    assert first.file.startswith("/data/wavs/camy_phoneme_similar/1-2-") and first.speaker.startswith("hard_negative_")


def test_manifest_defaults(spark, tmp_path):
    head = ",".join(presets.MANIFEST_FIELDS)
    blank = "," * (len(presets.MANIFEST_FIELDS) - 3)
    path = write(str(tmp_path), "m.csv", f"{head}\na.wav,,{blank}\n/abs/b.wav,_unknown_,{blank}\nc.wav,other,{blank}\n,,{blank}\n")
    got = sorted((r.file, r.speaker, r.hardneg_category) for r in readers.hard_negative_manifests(spark, "/r", {"t": path}).collect())
    assert got == [("/abs/b.wav", "hard_negative_unknown_speaker", "unknown_hard_negative"), ("/r/a.wav", "hard_negative_unknown_speaker", "unknown_hard_negative")]


def test_trace_and_metrics(spark, tmp_path):
    path = write(str(tmp_path), "trace.txt", '{"train": {"loss": 0.3}, "epoch": 0}\n{"train": {"loss": 0.25}, "epoch": 1}\n')
    assert [tuple(r) for r in readers.metric_trace(spark, path).orderBy("epoch").collect()] == [(0, 0.3), (1, 0.25)]
    out = str(tmp_path / "metrics")
    for _ in range(2):
        sinks.append_metrics(spark.createDataFrame([(1, 0.5)], "ep int, auc double"), out)
    assert spark.read.json(out).count() == 2


def test_model_versions(spark, tmp_path):
    folder = str(tmp_path / "model")
    protos = spark.createDataFrame([(0, [1.0, 0.0])], "class int, proto array<double>")
    sinks.save_model(protos, spark.createDataFrame([(0.5,)], "thr double"), folder)
    again, meta = sinks.load_model(spark, folder)
    sinks.save_model(again, meta.withColumn("thr", F.col("thr") + 0.25), folder)  # rebuilt from itself
    assert sinks.load_model(spark, folder)[1].first().thr == 0.75


def test_required_classes(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "label string")
    assert R.require_classes(rows, ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="no records for class z"):
        R.require_classes(rows, ["a", "z"]).collect()


def test_option_errors(spark):
    one = spark.range(1)
    assert one.select(R.parse_options(F.lit(" a=1, b = 2.5 ,")).alias("m")).first().m == {"a": 1.0, "b": 2.5}
    with pytest.raises(Exception, match="name=value"):
        one.select(R.parse_options(F.lit("a=1,b")).alias("m")).collect()
