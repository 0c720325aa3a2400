"""Template residue, filler, error pages and demands for scripts among texts.

A text is taken apart into its messages: the sentences of its lines outside
code, with numbers, addresses and dates masked. Equal messages are grouped
across all sources by the hash of this form, and every distinct one is
classified once: placeholder and phrase rules name its kind, and a message that
no rule names is page furniture if it recurs in many sources, else content. A
text is residue when it has an unfilled placeholder, or when residue is all
that it has: some message of it is an error, a script notice or filler, and
none is content.

The texts are read once. What is written, shuffled and joined after that are
hashes, and the messages of the few texts without a line that is content by its
form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut, evenly

#: Sources in which a message without a kind has to recur to count as page furniture.
RECURRING = 5
#: What a placeholder has in it; other lines aren't searched for one.
MARKS = r"[{$%@<【«‹⟨⟦〈\[]|__|&lt;"
OPEN_LINE = rf"(?m)^[^\n]*?(?:{MARKS})[^\n]*"

# Words that templates use for their fields.
FIELDS = (
    "title|name|date|time|author|owner|source|topic|project|summary|status|tag|tags|slug|user|username|email|company|version|description|content|body|"
    "subject|page|id|url|n|index|count|total|category|department|address|phone|year|month|day|"
    "标题|名称|姓名|日期|时间|作者|来源|负责人|主题|摘要|项目|状态|标签|内容|正文|描述|版本|编号|公司|部门|地址|电话|链接"
)
_WORD = r"[A-Za-z_一-鿿][\w.一-鿿-]{0,39}"
_CAPS = r"[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)*"
_OF_FIELD = rf"(?:[A-Za-z]+[_.])?(?:{FIELDS})(?:[_.][A-Za-z]+)?"
_TAGS = r"(?:A|B|I|U|P|Q|S|BR|HR|H[1-6]|DIV|SPAN|UL|OL|LI|TABLE|TR|TD|TH|PRE|IMG|HTML|HEAD|META|SCRIPT|STYLE|FORM|INPUT|EM|STRONG|NAV)"

#: A placeholder that was never filled in, outside code.
PLACEHOLDER = "|".join((
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}", r"\{[%#][^{}\n]{1,80}[%#]\}", r"<%[^<>\n]{1,80}%>", r"\$\{[^{}\n]{1,60}\}",
    rf"\$\((?:{_OF_FIELD}|{_CAPS}|[一-鿿]{{1,8}})\)", rf"(?<![\w$])\$(?:{_OF_FIELD})(?![\w])",
    rf"(?<![{{$%#\w\\])\{{{_WORD}\}}(?!\}})", rf"(?<![%\w])%(?:{_OF_FIELD}|{_CAPS}|[一-鿿]{{1,8}})%(?![\w])",
    rf"(?<![_\w])__(?:{_CAPS}|[一-鿿]{{1,8}}|date|status|title|author|owner|source|topic|project|summary|n)__(?![_])",
    rf"#\{{{_WORD}\}}", rf"[«‹⟨⟦〈]\s?(?:{_CAPS}|{_OF_FIELD})\s?[»›⟩⟧〉]",
    rf"@@{_WORD}@@", rf"(?:<|&lt;)(?:(?!{_TAGS}(?:>|&gt;)){_CAPS}|[一-鿿]{{1,8}}|{_OF_FIELD}|(?i:your|insert|enter) [^<>&\n]{{1,30}}|请(?:填写|输入)[^<>&\n]{{0,20}})(?:>|&gt;)",
    rf"【(?:{_CAPS}|{_OF_FIELD}|(?:待|请)?(?:填写?|补充?|输入)[^】\n]{{0,20}}|此处[^】\n]{{0,20}})】",
    r"(?<!\[)\[(?i:insert|enter|add|your) [^\[\]\n]{1,40}\](?!\()", r"(?<!\[)\[[^\[\]\n]{1,30} (?i:here|goes here)\](?!\()", r"(?<!\[)\[(?:TODO|TBD|FIXME)\b[^\[\]\n]{0,40}\](?!\()",
))
#: A filename's stem that is a placeholder, or what a program writes for a missing value.
BAD_NAME = rf"{PLACEHOLDER}|^(?:{_OF_FIELD})?\$(?:{_OF_FIELD})|<(?:untitled|unknown|none|null|empty)>|%[sd]\b|\[object \w+\]|^\W*(?i:undefined|null|none|nil|nan|n/?a|untitled|\(null\))(?:\W+(?i:undefined|null|none|nil|nan))*\W*$|#(?:REF|N/A|VALUE|NAME)[!?]?"

_SCRIPT = r"(?:java ?script|js|scripts?|scripting)"
#: Messages that a page shows instead of its content.
NOTICE = "(?U)" + "|".join((
    rf"\b(?:enable|turn on|switch on|allow|activate)\b.{{0,20}}\b{_SCRIPT}\b", rf"\bneeds? {_SCRIPT}\b", rf"\b{_SCRIPT}\b.{{0,12}}\b(?:turned off|switched off|disabled|is off|required|blocked|not enabled)",
    rf"\b(?:only|works?) with {_SCRIPT}\b", rf"\brun {_SCRIPT} before\b", r"</?noscript", rf"(?:启用|打开|开启|允许|禁用了?|关闭了?)\s*(?:{_SCRIPT}|脚本)", r"(?:启用|打开|开启|禁用了?|需要)脚本", r"正在(?:验证|检查)您的浏览器",
    r"^(?:<h\d>|#+ )?\s*(?:error|http|status)?[ :]*[45]\d\d(?:\b|(?=<))(?:[\s:.–—-]*(?:</h\d>)?(?:<p>)?(?:not found|forbidden|unauthori[sz]ed|bad gateway|bad request|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|request time-?out|gone|method not allowed|conflict|payment required|not acceptable)?)(?:\b.{0,60})?$",
    r"^(?:not found|forbidden|unauthori[sz]ed|bad gateway|gateway time-?out|service unavailable|internal server error|access denied)\W*$",
    r"unhandled exception|traceback \(most recent|stack ?trace|nullreference", r"took too long to respond", r"could not (?:resolve|be reached|connect)|can.t be reached|upstream connect error|(?:failure or )?reset before headers|connection (?:refused|reset|timed out)",
    r"\boops\b|something (?:went wrong|broke)|lost that page|leads nowhere|page (?:not found|cannot be found|does not exist|you.{0,20}looking for)", r"down for (?:planned |scheduled )?maintenance|under maintenance|be back (?:at|soon|shortly)",
    r"session (?:has )?(?:ended|expired|timed out)|sign in (?:again )?to continue|log ?in to continue", r"access to .{1,60} (?:was|is|has been) (?:refused|denied|blocked)|you don.t have (?:permission|access)|access denied|unusual (?:activity|traffic)",
    r"^\W*\{\W*(?:status|code|error|errcode)\W+[45]\d\d\b", r"too many (?:attempts|requests)|confirm (?:that )?you are (?:a person|human|not a robot)|verify you are human|complete the captcha", r"(?:page|post|content) (?:has been|was) (?:deleted|removed)|no longer available",
    r"网关(?:超时|错误)|服务(?:器内部错误|不可用|暂不可用)|内部服务器错误|没有访问权限|无权访问|拒绝访问|访问(?:被拒绝|受限|过于频繁)|(?:页面|网页|文件)(?:不存在|未找到|丢失|走丢)|找不到(?:该|您|这个)?.{0,6}页面|暂时无法(?:打开|访问)|数据库连接失败|连接(?:超时|被重置|失败)",
    r"系统.{0,4}维护|维护中|登录(?:状态)?已(?:过期|失效)|请(?:重新)?登录后|安全验证|拖动滑块|请完成验证|人机验证|(?:该|此)?内容已被.{0,6}(?:删除|设为)|已被删除|内容已(?:下线|失效|过期|移除)|请求过于频繁|操作过于频繁|您的访问",
))
#: Text that only fills its place.
FILLER = "(?U)" + "|".join((
    r"^\W*(?:(?:placeholder|dummy|sample|filler|example|body) (?:copy|text|words?|paragraph|content)\b.{0,50}[.,;!。]?\s*){1,}$", r"^\W*(?:some )?dummy (?:words|text)", r"^\W*your text (?:goes )?here", r"^\W*(?:body )?copy to come",
    r"^\W*(?:lorem ipsum|lipsum)\b(?!.*\b(?:the|of|was|were|by|and|to|is|with|from|for)\b)", r"^\W*(?:(?:asdf|asdfasdf|asdfgh|qwer|qwerty|zxcv|zxcvb|jkl|hjkl|foo|bar|baz|qux|x{3,}|test|testing|blah|text|lorem|ipsum|dolor)[\W_]*){3,}$",
    r"^\W*(?:占位文(?:本|字)|示例文字|示例文本|测试文(?:本|字)|填充文(?:本|字))(?!要).{0,12}(?:[。，,.]|$)", r"^\W*(?:这里|此处)(?:是|填写|输入|放).{0,6}(?:示例|说明|占位|正文|内容)", r"^(?=.*\p{L})\s*(.{2,60}?)(?:\s*\1){2,}\W*(?:.{0,60})$", r"^\W*(?:(?:正?文?内容|测试|文字)\W*){3,}$",
    r"^\W*(?:(?:[a-z]{1,12}(?:um|us|is|et|or|endo|ara|ia|it|am|em|at|unt|ur|ae|que|amus)|sed|do|ut|in|ad|ex|ea|non|quis|dolore|labore|amet|lipsum|ipsum|lorem|elit|magna|aliqua)\W+){6,}$",
))
#: A section without anything in it yet.
EMPTY = r"(?U)^[\W_]*(?:(?:tbd|tba|todo|fixme|wip|n/?a(?: yet)?|none yet|to be (?:written|done|added|completed|filled in?)|fill (?:me|this) in|coming soon|x{2,}|待补充?|待完善|待填写?|待定|待写|暂无(?:内容)?|略|以后写|未完待续|空)[\W_]*)+$|^\W*[…⋯.。]{1,6}\W*$|^[\s\-–—_*.…?？]{1,6}$"
#: Furniture of a page.
FURNITURE = "(?U)" + "|".join((
    r"^\W*(?:menu|home|login|log in|sign in|sign up|register|docs?|products?|about|contact|help|search|retry|reload|back|next|privacy|terms|forgot password|check the \w+|loading|请稍候|加载中|首页|文档|社区|登录|注册|帮助中心|隐私|条款|返回首页|联系我们|看看别的|热门|最新|关注|刷新|重试)(?:[\W_]+(?:menu|home|login|log in|sign in|sign up|register|docs?|products?|about|contact|help|search|retry|reload|back|next|privacy|terms|forgot password|check the \w+|首页|文档|社区|登录|注册|帮助中心|隐私|条款|返回首页|联系我们|热门|最新|关注|刷新|重试))*\W*$",
    r"^\W*(?:©|\(c\)|copyright\b|all rights reserved|版权所有)", r"^\s*at [\w.$<>]+\(", r"^\s*\[[ x]\] ", r"\b(?:has been logged as|reference(?: number| id)?[ #:]|request id|ray id|error id)\b", r"^(?:go back|return) to |\btry again (?:in|later)|if you (?:believe|think) this is|write to the site owner|refresh the page|^if nothing happens",
    r"^[\w.-]{1,40}/\d[\d.]*$", r"请(?:稍后再试|联系管理员|刷新页面)|敬请谅解",
))
#: Lines that are content whatever they hold: tables, links, list items, code.
MATTER = r"(?m)^[^\S\n]*(?:\||[-*+] |\d+[.)] |>)|\[\[|\u0001"
#: Where one message ends and the next begins.
SENTENCE = r"^\s+|\s*\n\s*|\s+$|(?<=[。！？!?])\s*|(?<=\.)\s+"
_LABEL = r"^[^。！？.!?，,：:；;]{1,40}$"

_FENCE = r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\z)"


def outside_code(body: Column) -> Column:
    """``body`` with every fenced block as a mark of content and every code span as a word."""
    plain = F.regexp_replace(body, r"\r\n?", "\n")
    cleared = F.regexp_replace(F.regexp_replace(plain, _FENCE, "\n\u0001\n"), r"(`{1,2})[^`\n]+\1", "\u0001")
    return F.when(F.contains(body, F.lit("`")) | F.contains(body, F.lit("~~~")), cleared).otherwise(plain)


def masked(text: Column) -> Column:
    """``text`` with every number, date, time, number address and hexadecimal name as 0. Status numbers from 400 to 599 stay."""
    return F.regexp_replace(text, r"\b(?=[a-f]*\d)[0-9a-f]{8,}\b|(?<!\d)(?![45]\d\d(?!\d))\d+(?:[-/.:年月]\d+)*日?", "0")


def without_addresses(text: Column) -> Column:
    """``text`` with web and mail addresses as one stand-in."""
    out = F.regexp_replace(text, r"(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.]+", "a://")
    return F.when(F.contains(text, F.lit("://")) | F.contains(text, F.lit("www.")) | F.contains(text, F.lit("@")), out).otherwise(text)


def kind(message: Column) -> Column:
    """notice, filler, empty, head, furniture, label, or message where no rule says."""
    message = F.lower(message)
    bare = F.regexp_replace(message, r"^#+\s+", "")
    return (
        F.when(bare.rlike(NOTICE), "notice").when(message.rlike(EMPTY), "empty").when(message.rlike(FILLER), "filler")
        .when(message.rlike(r"^#{1,6}\s"), "head").when(message.rlike(FURNITURE), "furniture").when(message.rlike(_LABEL) & (F.size(F.split(message, r"\s+")) <= 3), "label").otherwise("message")
    )


def _messages(notes: DataFrame, note_id: str, filename: str, body: str, source: str) -> DataFrame:
    """``key, id, bad_name, s, hs, open, told`` of every note, from one pass over its text.

    ``hs``: hashes of its messages. ``open``: masked lines with the mark of a
    placeholder. ``told``: its messages where no line of it is content by its form, else null.
    """
    n = notes.select(F.col(note_id).alias("id"), F.col(filename).alias("f"), outside_code(F.col(body)).alias("b"), F.coalesce(source, filename).alias("s"))
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("f", r"/(?![^<>]*>)"), -1), r"\.\w{1,5}$", ""), r"-(?:[cp]\d+|index)$", "")
    n = n.select("id", F.coalesce(stem.rlike(BAD_NAME), F.lit(False)).alias("bad_name"), F.xxhash64("s").alias("s"), F.col("b").rlike(MATTER).alias("matter"), masked(F.col("b")).alias("b"))
    m = F.filter(F.split(without_addresses(F.col("b")), SENTENCE), lambda x: x != "")
    n = n.select("id", "bad_name", "s", "matter", F.regexp_extract_all("b", F.lit(OPEN_LINE), F.lit(0)).alias("open"), F.array_distinct(m).alias("m"))
    return n.select(F.monotonically_increasing_id().alias("key"), "id", "bad_name", "s", F.transform("m", lambda x: F.xxhash64(x)).alias("hs"), F.array_distinct("open").alias("open"), F.when(~F.col("matter") & (F.size("m") > 0), F.col("m")).alias("told"))


def _distinct(rows: DataFrame, *keys: str) -> DataFrame:
    """Every message ``m`` of ``rows`` once, evenly over all tasks: by a key of its own, as Spark would leave out a shuffle by the same one, and grouped once more so that no filter moves before it."""
    once = rows.groupBy(*keys).agg(F.min("m").alias("m")).withColumn("part", F.xxhash64(*keys))
    return evenly(once, "part").groupBy("part", *keys).agg(F.min("m").alias("m"))


def classify(notes: DataFrame, note_id: str = "chunk_id", filename: str = "filename", body: str = "body", source: str = "chunk_of", recurring: int = RECURRING) -> DataFrame:
    """``note_id, reason`` of every note: placeholder_name, placeholder, stand_in, or null for real content.

    A placeholder in the filename or, outside code spans and fences, in the
    body makes a note residue wherever it stands. Filler, an error message or a
    scripts notice does so only where nothing in the body is content: a message
    that no rule names counts as furniture if it stands in ``recurring`` or more
    sources, else as content; tables, lists, quotes, links and code are content.
    Texts of any length are treated alike. Null and blank bodies and null
    filenames have no residue. Notes without a source are one source by their
    filename. Repeated rows are judged each; an empty table gives no rows;
    other columns are not read.
    """
    n = cut(_messages(notes, note_id, filename, body, source))
    spread = cut(n.select("s", F.explode("hs").alias("h")).distinct().groupBy("h").agg(F.count("*").alias("sources")).where(F.col("sources") >= recurring).select("h"))
    # one message that no rule names and that doesn't recur proves content: the longest of each text is asked first, and the others only where it proves nothing
    longest = F.array_max(F.transform("told", lambda x: F.struct(F.char_length(x).alias("n"), x.alias("m"))))["m"]
    told = n.where("told is not null").select("key", "told", longest.alias("m")).withColumn("h", F.xxhash64("m"))
    proof = _distinct(told, "h").where(kind(F.col("m")) == "message").select("h").join(spread, "h", "left_anti")
    asked = told.join(proof, "h", "left_anti").select("key", F.lit(False).alias("line"), F.explode("told").alias("m")).unionByName(n.select("key", F.lit(True).alias("line"), F.explode("open").alias("m")))
    asked = asked.withColumn("h", F.xxhash64("m"))
    # every distinct message once
    named = _distinct(asked, "line", "h")
    named = named.select("line", "h", F.when(F.col("line"), F.when(F.col("m").rlike(PLACEHOLDER), "placeholder")).otherwise(kind(F.col("m"))).alias("kind")).where("kind is not null")
    known = named.join(spread.withColumn("recurs", F.lit(True)), "h", "left").select("line", "h", F.when((F.col("kind") == "message") & F.col("recurs"), "furniture").otherwise(F.col("kind")).alias("kind"))
    met = asked.select("key", "line", "h").join(known, ["line", "h"])
    has = lambda *k: F.max(F.col("kind").isin(*k))
    judged = met.groupBy("key").agg(has("placeholder").alias("open_body"), (has("notice", "filler", "empty") & ~has("message")).alias("stands"))
    return n.select("key", "id", "bad_name").join(judged, "key", "left").select(
        F.col("id").alias(note_id), F.when(F.col("bad_name"), "placeholder_name").when(F.col("open_body"), "placeholder").when(F.col("stands"), "stand_in").alias("reason"))


def without_residue(notes: DataFrame, note_id: str = "chunk_id", **names: str) -> DataFrame:
    """The rows of ``notes`` whose id ``classify`` gives no reason for."""
    bad = classify(notes, note_id, **names).where("reason is not null").select(note_id).distinct()
    return notes.join(bad, note_id, "left_anti")
