import pytest

from lineloom.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    spark = local_session(4, 4)
    ship(spark)
    return spark
