import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spanlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(tmp_path_factory):
    """Three documents with two questions each, and the matching two-row category file."""
    folder = tmp_path_factory.mktemp("corpus")
    names = ["Anti-Assignment", "Governing Law"]
    ask = [f'Highlight the parts (if any) related to "{n}" that should be reviewed.' for n in names]
    texts = [
        "1. Assignment\nNo party may assign this Agreement without consent. Any transfer is void.\n2. Law\nThis Agreement is governed by the laws of Ohio.",
        "1. Assignment\nAssignment requires consent. Notices go by mail.\n2. Law\nThe laws of Texas apply to this contract.",
        "Nothing here is about that topic. It is short.",
    ]
    golds = [
        [["No party may assign this Agreement without consent."], ["This Agreement is governed by the laws of Ohio."]],
        [["requires consent"], ["The laws of Texas apply to this contract.", "Notices go by mail."]],
        [[], []],
    ]
    data = [
        {
            "title": f"Contract {i}",
            "paragraphs": [
                {
                    "context": text,
                    "qas": [
                        {"question": ask[q], "is_impossible": not golds[i][q], "answers": [{"text": t, "answer_start": 0} for t in golds[i][q]]}
                        for q in range(2)
                    ],
                }
            ],
        }
        for i, text in enumerate(texts)
    ]
    (folder / "corpus.json").write_text(json.dumps({"version": "x", "data": data}), encoding="utf-8")
    head = "Category (incl. context and answer),Description,Answer Format,Group\n"
    body = '"Category: Anti-Assignment","Description: May it be assigned, or not?",Answer Format: Yes/No,Group: 1\nCategory: Governing Law,Description: Which law applies?,Answer Format: Name of state,Group: -\n'
    (folder / "categories.csv").write_text("﻿" + head + body, encoding="utf-8")
    return {"folder": folder, "corpus": str(folder / "corpus.json"), "categories": str(folder / "categories.csv"), "texts": texts}
