"""Fixed patterns and word lists of the exam-paper format, in Java syntax ((?U): Unicode classes)."""

# What marks numbers, headings, declared counts and ranges.
QUESTION_NUMBER = r"(?sU)^\s*(?:#{1,6}\s*)?(\d{1,3})[\.．、]\s*(.*)"
LEADING_NUMBER = r"(?U)^\s*(?:#{1,6}\s*)?\d{1,3}\s*[\.．、)]\s*"
INLINE_NUMBER = r"(?U)(?<![A-Za-z0-9_])(\d{1,3})[\.．、]\s*(?=[一-鿿A-Za-z$（(])"
IMAGE_EXTENSION = r"(?iU)^\s*(?:jpe?g|png|webp|gif|bmp|tiff?)(?:\b|[)\]}>,._/-])"
PAPER_TOTAL = r"(?U)(?:本试卷|全卷|试卷)[^\n。；;]{0,40}?(?:共|共有)\s*(\d{1,3})\s*题"
SECTION_COUNT = r"(?U)(?:本大题|大题)?\s*(?:共有|共)\s*(\d{1,3})\s*(?:个\s*)?(?:小题|题)"
SECTION_RANGE = r"(?U)第\s*(\d{1,3})\s*(?:[~～\-]|\\~)\s*(\d{1,3})\s*题"
GENERIC_HEADING = (
    r"(?U)^(?:专题|考点|考向|题型|真题(?:感知|演练|汇编)?|模拟(?:预测|演练)?|基础(?:过关)?练|能力(?:提升)?练|综合(?:训练|检测)|易错(?:题)?|热点(?:题)?)"
    r"\s*(?:\d{1,3}|[一二三四五六七八九十]{1,3})?(?:[、.．:：-]\s*)?.{0,32}$"
)
NUMBERED_HEADING = r"(?U)^[一二三四五六七八九十]+[、.．]\s*|^第[一二三四五六七八九十\d]+[部分章节题]\b"
# What makes a numbered line a question, a list item or a preface.
SOURCE_TAG = r"(?U)^\s*(?:[（(]\s*)?(?:19|20)\d{2}[·.、\-—]"
STEM_CUE = (
    r"(?U)已知|若|设|下列|则|求|证明|计算|化简|判断|满足|定义|命题|函数|集合|复数|充要条件|充分|必要|取值范围|完成|补全|观察|选择|如图|"
    r"第[一二三四五六七八九十\d]{1,3}题|等于|为\s*[（(]|是\s*[“\"]|________|____|（\s*）|\(\s*\)"
)
LIST_EXPLANATION = r"形式|覆盖面|要求考生|不再直接|定义了|这要求|不仅是|而是在考|试题主要|重点考查|侧重|转向|回归本质|创新考法"
PREFACE = r"本试卷|试题卷|答题纸|考生注意|考试时间|规定位置|计算器|注意事项|姓名|准考证|班级|学校"
# Labels of parts, images, solutions and tails.
SUB_LABEL = r"(?U)(?:^|[\r\n]+|[ \t　]+|[。；;：:]\s*)([（(]\s*(?:\d{1,2}|[一二三四五六七八九十]{1,3})\s*[）)]|[①②③④⑤⑥⑦⑧⑨⑩])"
IMAGE_REF = r"(?U)!\[[^\]]*]\s*\(\s*<?([^>)\s]+)>?(?:\s+['\"][^)]*['\"])?\s*\)"
TAIL = r"(?imU)^[ \t]*(?:#{1,6}[ \t]*)?(?:\d{4}\s*年[^\n]{0,80}(?:试卷|考试|真题)|参考答案(?:与|及)?(?:试题)?解析|参考答案|答案解析|试题解析|答案与解析)"
ANSWER_HEADING = r"(?imU)^\s*#{0,6}\s*(参考答案与试题解析|参考答案|答案与解析|试题答案|详解)\s*$"
SOLUTION_MARKER = r"(?imU)【\s*(?:参考答案|答案|解析|详解|分析|解答)\s*】|(?:^|[\r\n]+)[ \t]*(?:参考答案|答案|解析|详解|分析|解答)\s*[:：]\s*"
REASONING = r"因为|所以|由题|可得|解得|证明|计算|根据|对于|若|则"
OPTION_MARKER = (
    r"(?U)(?:^|[\r\n]+|[ \t　]+|[。；;：:，,、?？）)]\s*)(?:[-*+]\s*)?(?:[（(]?[A-Ha-hＡ-Ｈａ-ｈ][）)]|[A-Ha-hＡ-Ｈａ-ｈ][\.．、:：])\s*"
    r"|(?<=[一-鿿）)\]}])[B-Hb-hＢ-Ｈｂ-ｈ][\.．、:：]\s*|(?:^|[\r\n]+)\s*(?:[-*+]\s*)?[A-Ha-hＡ-Ｈａ-ｈ](?=\s+)"
)
FILL_BLANK = r"填空|横线|空格|空白|空缺|补全|填写|填入|填上|写在|填在|_{2,}|＿{2,}|\\_"
IMAGE_CUE = r"如图|下图|图中|图示|示意图|图形|标志|图[①②③④⑤⑥⑦⑧⑨⑩一二三四五六七八九十1-9]"
