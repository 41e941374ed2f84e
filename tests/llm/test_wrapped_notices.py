"""License notices as they are wrapped in files."""

from folioforge.llm import licenses

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """/*
 * Copyright someone. Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 */"""


def test_hard_wrapped_notices_are_found(spark):
    apart = "Permission is hereby granted, free of charge\n\nto any person obtaining a copy of this software and associated documentation files"
    far = "Redistribution and use in source and binary forms\n" + "with many other words\n" * 20 + "or without modification are permitted provided that the following conditions are met"
    docs = spark.createDataFrame(list(enumerate([MIT, BSD, apart, far])), "doc_id long, text string")
    got = {r.doc_id: (list(r.more), r.score) for r in licenses.scan(docs).collect()}
    assert got == {0: (["mit"], 1.0), 1: (["bsd"], 1.0), 2: ([], 0.0), 3: ([], 0.0)}
