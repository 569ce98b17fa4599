import hashlib

import pytest

from tests.workbooks import workbook
from weftspark.session import clear_scratch, local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def books(spark, tmp_path_factory):
    from weftspark.sources import dictionaries

    path = tmp_path_factory.mktemp("dictionaries")
    head = lambda table: list(table[1])
    rules = [head(dictionaries.RULES), ["物料名称", "被套", "duvet cover", "", ""]]
    fabrics = [head(dictionaries.FABRICS), ["贡缎", "贡缎 60S*40S", "漂白色", "100%棉", "T300"], [None, "缎条 3cm", "漂白色", "C50/T50", "T250"], ["斜纹", "斜纹 灰", "灰色", "100C", "T300"]]
    styles = [head(dictionaries.STYLES), ["无飞边口袋无系带式", "无飞边", "无系带", "无拉链", "是", "否", "", ""], ["无飞边口袋有系带式", "无飞边", "有系带", "无拉链", "是", "否", "", ""], ["无飞边平口信封迎宾式", "无飞边", "无系带", "无拉链", "否", "是", "", ""], ["无飞边口袋无系带式 牙条", "无飞边", "无系带", "无拉链", "是", "否", "牙条", ""]]
    files = {"rules.xlsx": workbook([("被套 提取规则", rules, {}), ("面料类价格表", fabrics, {"merges": ["A2:A3"]})]), "styles.xlsx": workbook([("Sheet1", styles, {})])}
    for name, data in files.items():
        (path / name).write_bytes(data)
    hashes = [hashlib.sha256(d).hexdigest() for d in files.values()]
    return [f"{path}/{n}" for n in files], hashes
