"""Events read by expressions and events read by the XML parser give the same fields."""

from pyspark.sql import functions as F

from fleetscope.operators import events as ev

HEAD = '<event name="rpc_completed" timestamp="2024-01-01T10:00:07.579Z">'


def _doc(body: str, head: str = HEAD) -> str:
    return head + body + "</event>"


PLAIN = [
    _doc('<data name="duration"><value> 12 </value></data><action name="sql_text"><value>SELECT \t  *\n  FROM [t] WHERE a > 1</value></action>'),
    _doc('<data name="duration"><value>1</value></data><data name="duration"><value>2</value></data>'),
    _doc('<data name="duration"><value>x</value></data><data name="writes"><value></value></data><action name="username"><value></value></action>'),
    _doc('<action name="duration"><value>5</value></action><data name="username"><value>u</value></data>'),
    _doc('<data name="cpu_time"><type name="int64" package="package0"/><value>7</value><text>seven</text></data>'),
    _doc('<action name="username" package="sqlserver"><value>Zo\u00eb \U0001f600</value></action>',
         '<event name=" a b " package="sqlserver" timestamp="2024-01-01T10:00:07.179Z">'),
    _doc(""),
]
OTHER = [
    _doc('<data name="duration"><value>1</value></data><action name="sql_text"><value>a &lt; b</value></action>'),
    _doc('<action name="sql_text"><value><![CDATA[a < b]]></value></action>'),
    _doc('<action name="sql_text"><value>a ]]> b</value></action>'),
    _doc('<data name=" duration "><value>1</value></data>'),
    _doc("<data name='duration'><value>1</value></data>"),
    _doc('<data name="duration"><text>4</text></data>'),
    _doc('<data name="duration"><value>1</value></action>'),
    _doc('<data name="duration">\n <value>1</value></data>'),
    _doc('<data name="duration"><value>1</value></data><!-- <data name="writes"><value>2</value></data> -->'),
    _doc('<data name="duration"><value>1</value></data>', '<event timestamp="2024-01-01T10:00:07.179Z" name="a > b">'),
    _doc('<action name="sql_text"><value>a\rb\x01</value></action>'),
    HEAD + '<data name="duration"><value>1</value>',
    "", "no xml", None,
]


def test_plain_and_parsed_events_agree(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(PLAIN + OTHER)), "id int, event_data string")
    plain = {r.id for r in df.filter(ev._is_plain(F.col("event_data"))).collect()}
    assert plain == set(range(len(PLAIN)))
    got = {r.id: r for r in ev.shred_event(df, keep=["id"]).collect()}
    monkeypatch.setattr(ev, "_is_plain", lambda xml: xml.isNull() & F.lit(False))
    want = {r.id: r for r in ev.shred_event(df, keep=["id"]).collect()}
    assert got == want and len(got) == len(PLAIN + OTHER)
    assert got[0].duration == 12 and got[0].sql_text == "SELECT *\nFROM [t] WHERE a > 1" and got[1].duration == 1 and got[4].cpu_time == 7


def test_long_plain_event(spark):
    body = "".join(f'<data name="f{i}"><value>{i}</value></data>' for i in range(20_000)) + '<data name="duration"><value>3</value></data>'
    df = spark.createDataFrame([(_doc(body),)], "event_data string")
    assert df.filter(ev._is_plain(F.col("event_data"))).count() == 1
    assert ev.shred_event(df).first().duration == 3
