import pytest

from loomline.session import clear_folder, local_session, shared_folder


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    folder = shared_folder(session)
    session.stop()
    clear_folder(folder)
