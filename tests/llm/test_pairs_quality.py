import numpy as np
import pytest

from tarn.llm import pairs as A
from tarn.llm import quality as Q
from tarn.storage import Scratch

SOUND = "从文档看，保修从 2026-0{}-01 起算，共 1{} 个月[1]。同时，地址只能在出库前修改 [2]。"
ASK = "第 {} 台净水器的保修从哪一天开始算？"


def labelled(spark, cases, sound=300):
    rows = [(f"s{i:04d}", ASK.format(i), SOUND.format(i % 9 + 1, i % 10)) for i in range(sound)]
    rows += [(f"r{i}", ASK.format(i), "很遗憾，给出的材料不足以回答这个问题。") for i in range(12)]
    rows += [(f"e{i}", ASK.format(i), x) for i, x in enumerate(["", None, "N/A", "无", "[1]", "……", "​", "**  **", "（待补充）"])]
    rows += [(f"t{i}", ASK.format(i), "从文档看，地址只能在出库前修改。保修从 2026-03-01 起算，共，并且") for i in range(8)]
    rows += [(f"l{i}", ASK.format(i), "The warranty starts on the day that was written in the contract and it is valid for a year.") for i in range(8)]
    rows += [(f"c{i}", ASK.format(i), ASK.format(i)) for i in range(8)]
    rows += [(k, q, a) for k, (q, a, _) in cases.items()]
    df = spark.createDataFrame(rows, "id string, q string, a string")
    return {r.id: r.defect for r in A.label_pairs(df, "id", "q", "a", Scratch(spark, "t")).where("main").collect()}


CASES = {
    "x1": (ASK.format(1), "您问的是“" + ASK.format(1)[:-1] + "”。抱歉，我不能对此给出答复。", "refusal"),
    "x2": (ASK.format(2), "关于“" + ASK.format(2) + "”：" + SOUND.format(1, 2), None),
    "x3": (ASK.format(3), SOUND.format(3, 3) + "至于 PL1234，资料未提及。", None),
    "x4": (ASK.format(4) + "请用英文回答。", "The warranty starts on the day that was written in the contract.", None),
    "x5": (ASK.format(5), "환불은 14일 안에 처리될 예정입니다.", "language"),
    "x6": (ASK.format(6), ASK.format(6).replace("哪一天", "哪天") + "\n", "copy"),
    "x7": (ASK.format(7), "12 天。", None),
    "x8": (ASK.format(8), SOUND.format(4, 4).rstrip("。"), None),
    "x9": (ASK.format(9), "从文档看，地址只能在（", "truncated"),
    "y1": (ASK.format(10), "2026-03-01", None),
    "y2": (None, "从文档看，地址只能在出库前修改 [2]。", None),
    "y3": ("How long does the warranty last?", "La commande est partie de l'entrepôt à 12:10 et le remboursement prend des jours.", "language"),
    "y4": (ASK.format(11), "答：", "empty"),
}


def test_kinds_of_defects(spark):
    got = labelled(spark, CASES)
    assert {k: got.get(k) for k in CASES} == {k: d for k, (*_, d) in CASES.items()}
    for k, kind in (("r", "refusal"), ("e", "empty"), ("t", "truncated"), ("l", "language"), ("c", "copy")):
        assert {v for n, v in got.items() if n[0] == k and n[1:].isdigit() and len(n) < 4} == {kind}
    assert not [n for n in got if n[0] == "s"]


def test_repeats_and_nothing(spark):
    rows = [("a", "问题是什么呢？", ""), ("a", "问题是什么呢？", ""), (None, "x", "")]
    out = A.label_pairs(spark.createDataFrame(rows, "id string, q string, a string"), "id", "q", "a", Scratch(spark, "t"))
    assert out.count() <= 1
    none = spark.createDataFrame([], "id string, q string, a string")
    assert A.label_pairs(none, "id", "q", "a", Scratch(spark, "t")).count() == 0


def test_label_model_learns_who_is_right():
    r = np.random.default_rng(0)
    y = r.random(20000) < 0.05
    votes = np.stack([np.where(r.random(20000) < acc, np.where(y, 1, -1), np.where(y, -1, 1)) * (r.random(20000) < cover) for acc, cover in ((0.97, 0.9), (0.9, 0.8), (0.7, 0.9))], axis=1).astype(int)
    counts = {}
    for v in map(tuple, votes.tolist()):
        counts[v] = counts.get(v, 0) + 1
    post, share = A.fit(counts)
    assert abs(share - 0.05) < 0.02
    p = np.array([post[tuple(v)] for v in votes.tolist()]) > A.cutoff(post, counts)
    assert (p & y).sum() / y.sum() > 0.75 and (p & y).sum() / p.sum() > 0.75
    assert A.fit({}) == ({}, 0.0)


PROSE = "这说明早停策略并非在所有场景下都有收益，而且我们还比较了三种实现。用户研究共收集 25 份问卷，多数人偏好带引用的回答。"
KINDS = {
    "wrapped": ("\n".join(PROSE[i : i + 14] for i in range(0, len(PROSE), 14)) * 3, None),
    "dialogue": ("客服：最新轨迹停在保税库，包裹由门卫代收。\n买家：那什么时候能够到呢？\n客服：预计明天完成派送。", None),
    "list inside": (PROSE * 4 + "\n- 早停策略\n- 词表扩展\n- 温度缩放\n" + PROSE * 3, None),
    "bullets": ("目录\n" + "\n".join(f"- 词表扩展{i}" for i in range(20)), "list"),
    "numbers": ("\n".join(f"{i}. part KD{i}123" for i in range(1, 20)), "list"),
    "plain list": ("\n".join(["配件缺失", "知识蒸馏", "PL75650992", "柏灯旗舰店", "外壳开裂"] * 4), "list"),
    "pairs": ("\n".join(["仓库：东汀集散点", "状态：词表扩展", "颜色：偏好对齐"] * 5), "list"),
    "bars": ("| a | b | c |\n|---|---|---|\n" + "\n".join(f"| {i} | 焦糖 | 6 |" for i in range(9)), "table"),
    "csv": ("数量,状态,商品\n" + "\n".join(f"{i},焦糖,水壶" for i in range(9)), "table"),
    "columns": ("score         method        run\n" + "\n".join(f"28.{i}         Phive-Net     HC{i}6226" for i in range(9)), "table"),
    "letters": ("quqe wmyftui qzja gbsi kmzbpobfkxmhf epdhlihm rvves\nggey jngqi ofzi mhxxj,vtuhjog igp;rmzqe,h geebjxfndjxh\n" * 3, "junk"),
    "mojibake": ("娑堣瀺瀹為獙琛ㄦ槑锛屽幓鎺変綅缃�鎻掑�煎悗鎸囨爣涓嬮檷鍒� 18.809銆�\n" * 3, "junk"),
    "repeat": ("登录后查看" * 30, "junk"),
    "markup": ('</span></div></td><td>85zt30181273\n<div class="c88"><span id="hc48977460">\n.x76{margin:0;color:#rn48879233}\n' * 3, "junk"),
    "base64": ("BfhdRXqBaUrjIwNQ1VDgoYxP5uGPAO39Wf1n0J/TrvFwOK8GP0H9VIh4 =\n" * 4, "junk"),
    "english": ("He who asks about passage splitting should first read the note on distillation. The numbers in the table are means over 7 runs.", None),
    "banner": (("欢迎光临我们的旗舰店铺请多多关注收藏" * 12), "junk"),
    "long banner": (("本店所有商品均支持七天无理由退换请放心购买并联系客服咨询" * 9), "junk"),
    "repeated lines": ("这一行文字会在这个页面里反复出现很多次没有别的内容\n" * 30, "junk"),
    "wide table": ("\n".join("    ".join(f"列{j}值{i}{j}" for j in range(60)) for i in range(9)), "table"),
    "long numbers": ("\n".join(f"{10**9 + i}. 零件 KD{i}123" for i in range(1, 20)), "list"),
    "empty": ("", None),
    "blank": (" \n\t\n", None),
    "null": (None, None),
    "long": (PROSE * 5000, None),
}


def test_kinds_of_texts(spark):
    rows = [(k, t, "x") for k, (t, _) in KINDS.items()]
    s = Q.text_statistics(spark.createDataFrame(rows, "id string, text string, n_lines string"), "id", "text").withColumn("kind", Q.kind())
    got = {r.id: r for r in s.collect()}
    assert {k: got[k].kind for k in KINDS} == {k: want for k, (_, want) in KINDS.items()}
    assert got["null"].n_lines == 0 and got["null"].prose_share is None
    assert got["english"].n_words == 22 and got["english"].punctuated_lines == 1.0
    assert Q.text_statistics(s.select("id").withColumn("text", s.id).limit(0), "id", "text").count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(3)
    score = r.normal(size=(11, 4)) * 2
    text = np.array([0] * 5 + [1] + [2] * 5)
    got = Q.viterbi(score, text)
    trans = Q._emissions()[2]
    for k in range(3):
        rows = np.flatnonzero(text == k)
        best = max(itertools.product(range(4), repeat=len(rows)), key=lambda p: sum(score[i, s] for i, s in zip(rows, p, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(p)))
        assert got[rows].tolist() == list(best)
    assert Q.viterbi(np.zeros((0, 4)), np.zeros(0, dtype=int)).tolist() == []


def test_batches_do_not_change_results(monkeypatch):
    texts = [t or "" for t, _ in KINDS.values()]
    whole = Q.describe(texts)
    monkeypatch.setattr("tarn.llm._text.CHARS_AT_ONCE", 50)
    assert Q.describe(texts).equals(whole)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_empty_describe(n):
    assert len(Q.describe([""] * n)) == n


def votes_of_fixed_pairs(spark, times):
    from pyspark.sql import functions as F

    rows = []
    for i in range(100 * times):
        name = "Quakor 已经升级到新版本。" if i % 100 == 0 else f"第 {i} 台由 Quakor 负责维修。"
        rows.append((i, name + f"从文档看，保修共 {i} 个月。", name + f"从文档看，保修共 {i} 个月。", False))
    rows += [(-1, "Quakor", "Quakor", True), (-2, "从文档看，地址只能在出", "从文档看，地址只能在出", True)]
    df = spark.createDataFrame(rows, "_key long, a string, _norm string, _open boolean")
    ends = A.sentence_ends(df, Scratch(spark, "t"))
    votes = A.labelling_functions()["truncated"]
    open_ = A._measured(A.prepared(df.where("_open").join(ends, "_key"), F.lit("由哪个品牌负责维修？"), F.col("a")).withColumn("_far", F.lit(None).cast("int")))
    return {r["_key"]: tuple(r[1:]) for r in open_.select("_key", *[c.alias(n) for n, c in votes.items()]).collect()}


def test_votes_do_not_change_with_the_size_of_the_table(spark):
    small, large = votes_of_fixed_pairs(spark, 1), votes_of_fixed_pairs(spark, 10)
    assert small == large
    assert large[-1][3] == -1 and large[-2][3] == 1


def test_edit_distance_equals_the_table():
    import random

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choices("甲乙丙", k=r.randrange(90))) for _ in range(2))
        assert A.edit_distance(a, b) == table(a, b)


def test_edited_copies_are_found_at_every_length(spark):
    import random

    r = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(900)]
    rows, want = [], {}
    for n in (300, 1990, 2010, 2500, 30_000):
        for i in range(8):
            q = "".join(r.choices(letters, k=n)) + "？"
            x = list(q)
            for at in r.sample(range(n), n // 20):
                x[at] = r.choice(letters)
            rows += [(f"c{n}-{i}", q, "".join(x)), (f"s{n}-{i}", q, "".join(r.choices(letters, k=n)) + "。")]
            want |= {f"c{n}-{i}": "copy", f"s{n}-{i}": None}
    rows += [(f"x{i:04d}", ASK.format(i), SOUND.format(i % 9 + 1, i % 10)) for i in range(300)] + [(f"y{i}", ASK.format(i), ASK.format(i)) for i in range(12)]
    got = {x.id: x.defect for x in A.label_pairs(spark.createDataFrame(rows, "id string, q string, a string"), "id", "q", "a", Scratch(spark, "t")).where("main").collect()}
    assert {k: got.get(k) for k in want} == want


def test_posteriors_equal_brute_force():
    import itertools

    r = np.random.default_rng(5)
    score, text, steps = r.normal(size=(9, 4)), np.array([0] * 4 + [1] + [2] * 4), Q.Model(stay=0.7).steps()
    got, stayed = Q.posteriors(score, text, steps)
    want, same = np.zeros(score.shape), 0.0
    for k in range(3):
        rows = np.flatnonzero(text == k)
        paths = list(itertools.product(range(4), repeat=len(rows)))
        w = np.array([np.exp(sum(score[i, s] for i, s in zip(rows, p, strict=True)) + sum(steps[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w, strict=True):
            same += x * sum(a == b for a, b in itertools.pairwise(p))
            for i, s in zip(rows, p, strict=True):
                want[i, s] += x
    assert np.allclose(got, want) and stayed == pytest.approx(same)


def test_chances_are_learned_and_keep_their_meaning(spark):
    texts = [t for t, _ in KINDS.values() if t and len(t) < 20_000] * 20
    m = Q.learn(texts, prior=50.0)
    assert m.stay > 0.9 and m.chance[list(Q.OBSERVATIONS).index("bullet"), 1] > m.chance[list(Q.OBSERVATIONS).index("bullet"), 0]
    got = Q.describe([t or "" for t, _ in KINDS.values()], m)
    alike = [(k, w) for (k, (_, w)), p in zip(KINDS.items(), got.prose_share, strict=True) if (p < 0.5) != (w is not None) and k not in ("empty", "blank", "null")]
    assert not alike
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    a, b = Q.fit_model(df, "text"), Q.fit_model(df.repartition(5), "text")
    assert np.allclose(a.chance, b.chance) and a.stay == b.stay
    assert np.allclose(Q.fit_model(df.limit(0), "text").chance, Q.Model().chance)


def test_expected_numbers_equal_posteriors():
    r = np.random.default_rng(7)
    obs, sizes, times = r.random((40, len(Q.OBSERVATIONS))) < 0.3, np.array([1, 12, 3, 20, 4]), np.array([1, 3, 2, 1, 5])
    m, text = Q.Model(stay=0.8), np.repeat(np.arange(5), sizes)
    got, lines = Q.expected(m, Q.patterns(obs), sizes, times), Q.patterns(obs)
    want, stayed = np.zeros((1 << len(Q.OBSERVATIONS), 4)), 0.0
    for k in range(5):
        p, same = Q.posteriors(m.score(obs[text == k]), np.zeros(sizes[k], dtype=int), m.steps())
        np.add.at(want, lines[text == k], times[k] * p)
        stayed += times[k] * same
    assert np.allclose(got[:-1].reshape(want.shape), want) and got[-1] == pytest.approx(stayed)


def test_the_model_comes_from_all_texts_and_not_from_their_number(spark):
    texts = [t for t, _ in KINDS.values() if t and len(t) < 2_000]
    texts = [f"{t}\n第 {i} 项" if i % 3 else t for i in range(4_000) for t in [texts[i * i % len(texts)]]]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", " \n"]], "text string")
    got, all_, twice = Q.fit_model(df, "text"), Q.learn(texts), Q.fit_model(df.union(df).repartition(3), "text")
    assert np.allclose(got.chance, all_.chance, atol=1e-6) and got.stay == pytest.approx(all_.stay, abs=1e-6)
    assert np.allclose(got.chance, twice.chance, atol=1e-6) and got.stay == pytest.approx(twice.stay, abs=1e-6)
