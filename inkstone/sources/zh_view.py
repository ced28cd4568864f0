"""A pseudo-Chinese view of documents: frequent Latin words become Chinese phrases.

The test tables hold no Chinese, so a rule on the raw text would find nothing.
Each slot swaps one word for a phrase that some detector looks for, or for a
near miss.  It is plain ``replace`` from top to bottom, alike in every engine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .store import once

#: Word between spaces, and what takes its place.
SLOTS = (
    ("the", "軟件"),
    ("of", "內存,"),
    ("and", "用戶.我們"),
    ("to", "的網絡服務器"),
    ("in", "！這個程序是不是已經運行了嗎？"),
    ("is", "他進行研究。他加以分析。他們離開了。"),
    ("that", "不只是速度，而是質量。"),
    ("it", "可能，也許，大概，或許。意味著改變。隨著科技的不斷發展，"),
    ("was", "——用戶——信息——軟體和網路，好:的"),
    ("for", "最重要的城市之一。標誌著新的時代。"),
    ("on", "因為下雨，所以取消。儘管面臨挑戰，仍將繼續前進。"),
    ("are", "根據報告顯示，大家都知道的問題的整個情況。說實話？"),
    ("with", "對數據進行分析，關鍵在於：不是速度，而是質量。"),
    ("as", "做出了決定。他吃了和我說了，他是好，影響到了。"),
    ("at", "“視頻”這是一段沒有任何停頓並且長達三十個字以上而且還在繼續說下去的句子所以讀起來真的非常累人。"),
    ("be", "被使用，被廣泛採用，被看見。他去了。他來了。他走了。\n- 請打開\n- 請關閉\n- 請離開\n"),
    ("this", "你好，您好。"),
    ("have", "儘管面臨挑戰，仍將繼續前進。\n# 結論\n標誌著新的時代。核心：不是速度，而是質量。"),
    ("from", "\n\n從大城市到小鄉村再到海邊，"),
    ("or", "蘋果，香蕉，橘子，"),
    ("by", "不是甲，而是乙。不是丙，而是丁。不是戊，而是己。CPU的GPU 文件"),
    ("which", "說實話？由此可見，這很重要。說實話？由此可見。\n\n"),
    ("not", "意味著改變，標誌著新的時代。"),
    ("de", "計算機"),
    ("la", "。紅色、藍色、綠色、換言之，意味著改變。"),
    ("le", "的人的書的頁的字，"),
    ("et", "的減少導致了問題。政策的實施效果的提升，推動的落實的發展，"),
    ("les", "是一個好的地方。"),
    ("des", "默認...鼠標，系統擁有擁有權，"),
    ("en", "如果可以，"),
    ("un", "打印。。。屏幕"),
    ("une", "Github和JAVASCRIPT很好"),
    ("du", "12:30到15~20公里，城市~鄉村 ，好！！"),
    ("que", "進程"),
    ("est", "他很好。他很忙。他很累。廢話不多說，"),
    ("pour", "C P U 和U S B 接口"),
    ("par", "https://example.com/軟件/說明 "),
    ("sur", "@user_軟件 「網絡」一詞"),
    ("dans", "非常非常好，研究研究"),
    ("der", "优化软件的质量与数据"),
    ("die", "用戶的"),
    ("und", "，可能，也許，大概，"),
    ("zu", "高興的跑，慢慢的走，慢慢地走，祖國的"),
    ("den", "在2024年曾已去過了。"),
    ("das", "不是結束，而是開始。\n\n被看見被發現被使用，被記住被忘記的人被找到。\n\n"),
    ("ein", "到底為什麼？因為愛。由此可見。\n\n"),
    ("eine", "\n# 總結與展望：軟件\n"),
    ("von", "\n- **重點**：說明\n- **結論**：說明\n- **方法**：說明\n"),
    ("ist", "希望對你有幫助。\n\n# 結論\n"),
    ("im", "​零寬\n// zhtw:disable-next-line\n軟件\n"),
    ("el", "……等等「未閉合"),
    ("los", "好（說明)與(備註)的。雖然下雨，但是他們去了。"),
    ("las", "１２３ｋｍ\n| 軟件 | 說明 |\n"),
    ("se", "文件夾，文件"),
    ("con", "敬啟者，本合約生效。"),
    ("no", "「外『內』外」實際上基本上(basically)如此，"),
    ("del", "眾所皆知，有研究指出，"),
    ("su", "這裡的故事告訴我們，發揮了關鍵作用。"),
    ("al", "領先時代10年。他會去，如果可以。"),
    ("es", "的。好的。對的。是的。工程序列，"),
)


def zh_expr(text: str = "text") -> str:
    for word, phrase in SLOTS:
        text = f"replace({text}, ' {word} ', '{phrase}')"
    return text


def zh_text(text: str) -> str:
    """The same of one text."""
    for word, phrase in SLOTS:
        text = text.replace(f" {word} ", phrase)
    return text


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        made = (t and zh_text(t) for i in range(0, len(texts), 128) for t in texts.slice(i, 128).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "zh"])


#: The view for the checking engine, where line breaks stand in literals as they are.
ZH_SQL = f"(SELECT doc_id, {zh_expr()} AS zh FROM documents)"


def zh_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, zh) of the documents of ``sf_dir``, written once; few parts are dealt over as many as the session shuffles into."""

    source = f"{sf_dir}/documents.parquet"

    def make() -> DataFrame:
        docs = spark.read.parquet(source).select("doc_id", "text")
        # Texts that are in parts enough stay where they are.
        if docs.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism:
            docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        return docs.mapInArrow(_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, zh string")

    return once(spark, "zh-" + hashlib.sha256(sf_dir.encode()).hexdigest()[:12], source, make)
