"""Word lists and weights of the retrieval model.  A caller may pass another Lexicon; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Field order and base weights of a document.
FIELDS = ("name", "research", "papers", "title", "profile", "college", "content")
BASE_WEIGHTS = {"name": 5.0, "research": 3.0, "papers": 2.0, "title": 1.5, "profile": 1.2, "college": 1.0, "content": 1.0}
#: How often a field's tokens count in the flat index: max(1, weight rounded half to even).
REPEATS = {k: max(1, round(v)) for k, v in BASE_WEIGHTS.items()}

# Facet names by alias.
COLLEGES = {
    "计算机科学与技术学院": ("计算机科学与技术学院", "计算机学院", "计科院", "软件学院"),
    "数学科学学院": ("数学科学学院", "数学学院"),
    "物理科学与技术学院": ("物理科学与技术学院", "物理学院"),
    "功能纳米与软物质研究院": ("功能纳米与软物质研究院", "纳米学院", "纳米研究院"),
    "未来科学与工程学院": ("未来科学与工程学院", "未来学院"),
}
# Query vocabulary.
TITLES = ("特聘教授", "副教授", "副研究员", "高级实验师", "教授", "讲师", "研究员", "实验师", "博导", "硕导")
PAPER_TERMS = ("论文", "成果", "发表", "期刊", "会议", "ACL", "CCF", "SCI", "Nature", "Arxiv", "H-index")
FILLERS = ("想找", "找", "做", "研究", "方向", "相关", "导师", "老师", "有没有", "推荐")
DESCRIPTIVE = ("研究", "从事", "做", "方向", "相关", "导师", "老师", "哪些", "有没有", "推荐", "理解", "分析", "应用")
SYNONYMS = {
    "自然语言处理": ("NLP", "中文信息处理", "机器翻译", "信息抽取", "文本挖掘", "文本理解"),
    "nlp": ("自然语言处理", "中文信息处理", "机器翻译", "信息抽取", "文本挖掘"),
    "机器翻译": ("自然语言处理", "NLP", "神经机器翻译", "统计机器翻译"),
    "信息抽取": ("自然语言处理", "实体识别", "关系抽取", "文本挖掘"),
    "文本挖掘": ("自然语言处理", "信息抽取", "文本理解", "数据挖掘"),
    "知识图谱": ("知识表示", "图数据", "智能问答", "语义网络", "实体关系"),
    "智能问答": ("知识图谱", "问答系统", "自然语言处理", "知识表示"),
    "问答系统": ("智能问答", "知识图谱", "自然语言处理", "知识表示"),
    "机器学习": ("深度学习", "模式识别", "人工智能", "数据挖掘"),
    "深度学习": ("机器学习", "神经网络", "人工智能", "计算机视觉"),
    "计算机视觉": ("图像处理", "模式识别", "医学图像", "深度学习"),
    "医学图像": ("计算机视觉", "图像处理", "医学影像", "深度学习"),
    "医学影像": ("医学图像", "计算机视觉", "图像处理", "深度学习"),
    "数据挖掘": ("机器学习", "知识发现", "图数据", "智能分析"),
    "图论": ("组合优化", "图算法", "离散数学"),
    "优化算法": ("组合优化", "运筹优化", "智能算法", "最优化"),
}
# Per query kind (name, research, papers, title, profile, college, content), expansion weight, expansion on, fuzzy on.
KINDS = {
    "name": ((8.0, 0.4, 0.3, 0.3, 0.3, 0.2, 0.2), 0.55, False, True),
    "research": ((0.6, 5.5, 1.4, 0.5, 1.3, 0.2, 0.7), 0.35, True, True),
    "college_research": ((0.8, 5.0, 1.8, 0.6, 1.4, 0.2, 0.9), 0.40, True, True),
    "colloquial": ((0.8, 5.0, 1.8, 0.6, 1.4, 0.2, 0.9), 0.75, True, True),
    "general": ((0.8, 5.0, 1.8, 0.6, 1.4, 0.2, 0.9), 0.55, True, True),
    "paper": ((0.5, 3.6, 3.2, 0.5, 1.0, 0.2, 0.6), 0.25, True, True),
    "title_research": ((0.5, 4.5, 1.8, 3.2, 1.0, 0.2, 0.8), 0.40, True, True),
    "title": ((5.0, 3.0, 2.0, 1.5, 1.2, 1.0, 1.0), 0.55, False, False),
    "college": ((5.0, 3.0, 2.0, 1.5, 1.2, 1.0, 1.0), 0.55, False, False),
}
SEMANTIC_KINDS = ("general", "research", "college_research", "title_research", "colloquial")

# Page structure.
PAGE_TITLES = ("高级实验师", "特聘教授", "副教授", "副研究员", "教授", "讲师", "研究员", "实验师")
HEADINGS = ("个人资料", "个人概况", "个人简介", "个人简历", "教育经历", "工作经历", "研究领域", "研究方向", "科研方向", "开授课程", "科研项目", "论文", "学术论文", "发表论文", "科研成果", "科技成果", "荣誉及奖励", "招生信息", "学术活动")
FIELD_ALIASES = {
    "research": ("研究方向", "研究领域", "科研方向", "主要研究方向", "研究兴趣", "目前主要研究方向"),
    "papers": ("代表论文", "论文", "发表论文", "学术论文", "科研成果", "主要成果", "代表性成果"),
    "profile": ("个人简介", "个人简历", "简介", "个人概况"),
    "title": ("职称", "专业技术职务", "职务", "岗位"),
    "college": ("直属机构", "院部/部门", "学院", "所在学院"),
}
SECTION_KEYS = {
    "research": ("研究领域", "研究方向", "科研方向"),
    "papers": ("论文", "学术论文", "发表论文", "科研成果", "科技成果"),
    "profile": ("个人简介", "个人简历", "个人概况"),
}
NAME_SKIP = ("学院", "大学", "首页", "教师个人主页", "导航", "目录", "English", "欢迎")
# The page classifier's tokens.
HARD_NEGATIVE = ("正在同步中，请稍后再试", "Service Temporarily Unavailable")
PAGE_POSITIVE = ("教师个人主页", "个人资料", "个人简介", "个人简历", "研究领域", "研究方向", "职称", "电子邮箱")
PAGE_ENGLISH = ("homepage", "biography", "research interest", "research interests", "research", "publications", "publication", "professor", "school of computer science")
PAGE_LISTING = ("学院列表", "教师分类查询", "热点主页", "最新更新")
TEMPLATE_COLLEGES = ("计算机科学与技术学院", "功能纳米与软物质研究院", "纳米科学技术学院", "数学科学学院", "物理科学与技术学院", "未来科学与工程学院")
TEMPLATE_TOKENS = ("研究兴趣", "论文发表", "论文与著作", "教授", "副教授", "讲师")


@dataclass(frozen=True)
class Lexicon:
    """All lists that depend on a corpus's language or organisation."""

    colleges: dict = field(default_factory=lambda: dict(COLLEGES))
    titles: tuple = TITLES
    paper_terms: tuple = PAPER_TERMS
    fillers: tuple = FILLERS
    descriptive: tuple = DESCRIPTIVE
    synonyms: dict = field(default_factory=lambda: dict(SYNONYMS))
    kinds: dict = field(default_factory=lambda: dict(KINDS))
    positive: tuple = PAGE_POSITIVE
    english: tuple = PAGE_ENGLISH  # an institution adds its own name here
    listing: tuple = PAGE_LISTING
    hard_negative: tuple = HARD_NEGATIVE
    template_colleges: tuple = TEMPLATE_COLLEGES
    template_tokens: tuple = TEMPLATE_TOKENS

    def aliases(self) -> list[tuple[str, str]]:
        """(alias, canonical), longest alias first, ties in list order."""
        return sorted(((a, c) for c, names in self.colleges.items() for a in names), key=lambda x: -len(x[0]))


DEFAULT = Lexicon()
