"""What the file forms and the interface say, word for word."""

# Speakers of a turn, as fragments quote them.
USER, AI = "[用户]：", "[AI]："

# Labels of a fragment's Markdown.
TASK_TITLE = "# 任务："
DATE, RANGE, TAGS, TOPIC, AGENT = "日期", "轮次", "标签", "主题", "Agent"
SUMMARY, RESULT, TURNS = "摘要", "结论", "原文"

# Labels of a topic's Markdown, and of the topic line of a daily summary.
TOPIC_TITLE = "# 主题："
COVERED, STATUS, STAGES, RULES = "涵盖日期", "状态", "各阶段", "关键约束"
ACTIVE, COMPLETED, DONE = "进行中", "已完成", "完成"
DAY_TOPICS = "涉及主题"

# Names of listed resources.
RAW_NAME, FRAGMENT_NAME, DAILY_NAME, TOPIC_NAME = "对话记录", "片段", "每日总结", "主题索引"

# Messages of the interface.
DAILY_WRITTEN = "每日总结已写入：daily/{}.md"
NO_FRAGMENT, NO_DAILY, NO_TOPIC, NONE = "片段不存在：{}", "该日期没有每日总结：{}", "主题不存在：{}。可用主题：{}", "无"
UNKNOWN_TOOL, TOOL_FAILED = "未知工具：{}", "执行 {} 时出错：{}"
BAD_URI, UNKNOWN_KIND, READ_FAILED = "无效的 memory:// URI", "未知 resource 类型：{}\n可用类型：raw, fragments, daily, topics", "读取失败：{}"
MISSING = {"fragments": "片段不存在", "daily": "每日总结不存在", "topics": "主题不存在"}
