"""Own vocabulary: rules by layer, character maps and marker lists."""

from __future__ import annotations

#: (from, to, type, severity, english, layer, clues, tags); severity 1 info, 2 warning, 3 error; suggestions and clues by "/".
RULES = (
    ("軟件", "軟體", "cross_strait", 2, "software", 0, "", "it"),
    ("硬件", "硬體", "cross_strait", 2, "hardware", 0, "", "it"),
    ("內存", "記憶體", "cross_strait", 2, "memory", 0, "", "it"),
    ("用戶", "使用者", "cross_strait", 2, "user", 0, "", "it"),
    ("進程", "行程/程序", "cross_strait", 2, "process", 0, "計算機/運行/內存", "it"),
    ("程序", "程式", "cross_strait", 2, "program", 0, "運行/軟件/計算機", "it"),
    ("網絡", "網路", "cross_strait", 2, "network", 0, "", "it"),
    ("服務器", "伺服器", "cross_strait", 2, "server", 0, "", "it"),
    ("計算機", "電腦", "cross_strait", 2, "computer", 0, "", "it"),
    ("信息", "資訊", "cross_strait", 2, "information", 0, "", "it"),
    ("視頻", "影片", "cross_strait", 2, "video", 0, "", "media"),
    ("默認", "預設", "cross_strait", 2, "default", 0, "", "it"),
    ("鼠標", "滑鼠", "cross_strait", 2, "mouse", 0, "", "it"),
    ("打印", "列印", "cross_strait", 2, "print", 0, "", "it"),
    ("屏幕", "螢幕", "cross_strait", 2, "screen", 0, "", "it"),
    ("文件夾", "資料夾", "cross_strait", 2, "folder", 0, "", "it"),
    ("文件", "檔案", "confusable", 1, "file", 0, "文件夾/打印/計算機", "it"),
    ("質量", "品質", "confusable", 2, "quality", 0, "軟件/產品", "term"),
    ("數據", "資料", "cross_strait", 2, "data", 0, "", "it"),
    ("接口", "介面", "cross_strait", 2, "interface", 0, "", "it"),
    ("運行", "執行", "cross_strait", 1, "run", 0, "程序/軟件", "it"),
    ("眾所皆知", "眾所周知", "typo", 3, "", 0, "", "phrase"),
    ("大概", "", "ai_filler", 1, "", 0, "", "filler"),
    ("希望對你有幫助", "", "ai_filler", 2, "", 0, "", "filler"),
    ("數據", "數據", "cross_strait", 1, "data", 1, "", "it"),
    ("視頻", "視訊", "cross_strait", 2, "video", 1, "", "media"),
    ("零寬", "零寬度", "variant", 1, "", 1, "", "term"),
    ("視頻", "影音", "cross_strait", 2, "video", 2, "", "media"),
    ("城市", "都市", "variant", 1, "city", 2, "", "optional"),
    ("祖國", "", "political_coloring", 1, "motherland", 0, "", "politics"),
)

#: Longer correct forms that swallow a match at their own offset.
EXCEPTIONS = ("用戶端點", "程序正義", "信息素", "數據機", "文件夾層")

#: Simplified characters and what they become; index-paired.
SIMPLIFIED = "优软质与据数时间关开发应产业务实现个们这说对进经过还没会为东车书长门问见贝页风飞马鱼鸟麦齐龙"
TRADITIONAL = "優軟質與據數時間關開發應產業務實現個們這說對進經過還沒會為東車書長門問見貝頁風飛馬魚鳥麥齊龍"

#: Written forms of names.
CASES = ("GitHub", "JavaScript", "TypeScript", "MySQL", "iPhone", "YouTube", "LinkedIn", "OpenAI", "macOS", "PostgreSQL")

#: Anchors of formal register.
FORMAL = ("敬啟者", "謹啟", "此致", "敬上", "鈞鑒", "順頌", "台端", "惠請", "檢附", "貴公司")
#: Phrases whose density is looked at, each with its threshold per 1,000 characters.
DENSITY = (("不僅", 1.0), ("然而", 1.5), ("此外", 1.5), ("總之", 1.0), ("隨著", 1.0), ("意味著", 1.0), ("標誌著", 0.8), ("至關重要", 0.8), ("不斷", 1.5), ("可能", 2.0))
#: Spoken markers.
ORAL = ("嗎", "吧", "呢", "啊", "喔", "啦", "哦", "嘛", "耶", "欸", "那個", "就是說", "然後", "對啊", "真的")
#: (term, trigger, suggestion) that settle an ambiguous term.
COLLOCATIONS = (("進程", "計算機", "行程"), ("進程", "歷史", "進程"), ("文件", "打印", "檔案"), ("文件", "簽署", "文件"), ("質量", "軟件", "品質"), ("質量", "公斤", "質量"))
#: Terms a glossary bans, and proper nouns it protects.
BANNED, PROPER = ("香蕉", "鼠標"), ("蘋果",)
#: Decisions kept in a translation memory: (found, chosen).
MEMORY = (("運行", "運行"), ("打印", "列印"))
IGNORED = ("接口",)


def values(rows: tuple, names: str, alias: str) -> str:
    """A relation of literal rows."""
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(q, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {alias}({names}))"
