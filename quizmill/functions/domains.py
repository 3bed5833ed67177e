"""Closed domains of extraction records, and small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of existing data.
LEVELS = ("实习", "校招", "社招", "未知")
ROUND_TYPES = ("技术一面", "技术二面", "技术三面", "技术四面", "技术五面", "HR面", "交叉面", "笔试", "主管面", "其他")
CATEGORIES = ("算法", "数据结构", "系统设计", "数据库", "操作系统", "网络", "语言基础", "项目", "HR", "深度学习", "计算机体系结构", "AI基础", "大模型", "其他")
UNKNOWN_LEVEL, OTHER = "未知", "其他"


def importance(content: Column) -> Column:
    """3, above 80 characters 4, above 200 characters 5."""
    n = F.length(content)
    return F.when(n > 200, 5).when(n > 80, 4).otherwise(3)


def excerpt(text: Column, size: int = 200) -> Column:
    """``text`` cut to ``size`` characters and an ellipsis if it is longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


#: White space of any script.
WIDE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_wide(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.trim(c, F.lit(WIDE))
