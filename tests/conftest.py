import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hourlens import schemas  # noqa: E402
from hourlens.session import builder  # noqa: E402
from hourlens.sources.star import Star  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tests").master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def d(text):
    return dt.date.fromisoformat(text) if text else None


@pytest.fixture(scope="session")
def small_star(spark):
    employee = [(1, "Alex Stone", "AS", "Engineering"), (2, "Robin Vale", "RV", "Engineering"),
                (3, "Sam Reed", None, "Sales")]
    project = [(1, "P-1", "Website Redesign"), (2, "P-2", "Mobile App")]
    hours = [
        (1, 1, "Design", 10.0, d("2025-01-06"), d("2025-01-12")),
        (1, 1, "Design", 5.0, d("2025-03-31"), d("2025-04-06")),
        (2, 2, "Review", 8.0, d("2025-02-03"), d("2025-02-09")),
        (3, None, "Meeting", 4.0, d("2025-01-13"), d("2025-01-19")),
        (2, 1, "Review", 7.0, None, d("2025-02-01")),
    ]
    return Star(spark.createDataFrame(employee, schemas.EMPLOYEE), spark.createDataFrame(project, schemas.PROJECT),
                spark.createDataFrame(hours, schemas.WORK_HOUR))


@pytest.fixture(scope="session")
def dictionary(spark):
    names = {"employee": ["Alex Stone", "Robin Vale", "Sam Reed"],
             "project": ["Website Redesign", "Mobile App", "Database Migration"],
             "department": ["Engineering", "Marketing", "Sales", "HR"]}
    return spark.createDataFrame([(k, n) for k, ns in names.items() for n in ns], schemas.DICTIONARY)


@pytest.fixture(scope="session")
def aliases(spark):
    rows = [("employee", "张三", 0, "Zhang San", 0), ("employee", "张三", 0, "张经理", 1),
            ("employee", "张三", 0, "Manager Zhang", 2), ("employee", "李四", 1, "Li Si", 0),
            ("employee", "李四", 1, "张经理", 1), ("department", "财务中心", 0, "Finance Center", 0),
            ("department", "财务中心", 0, "Finance Dept", 1)]
    return spark.createDataFrame(rows, schemas.ALIASES)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def ask(spark, *texts):
    ts = dt.datetime(2026, 2, 15)
    return spark.createDataFrame([(i, 1, ts, t) for i, t in enumerate(texts)], schemas.QUESTIONS)
