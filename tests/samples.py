"""Sample messages; expected values stand beside them in the tests."""

ADT_JONES = "\r".join(
    [
        r"MSH|^~\&|SENDING_APP|SENDING_FAC|RECEIVING_APP|RECEIVING_FAC|20230615083000||ADT^A01|MSG00001|P|2.5",
        "EVN|A01|20230615083000",
        "PID|1||123456789^^^FACILITY^MR||JONES^WILLIAM^A||19800515|M|||123 MAIN ST^^CITY^ST^12345",
        "PV1|1|I|2000^2012^01||||004777^SMITH^JOHN^A|||SUR||||ADM|A0",
        "",
    ]
)
ORU_CBC = "\r".join(
    [
        r"MSH|^~\&|LAB|FACILITY|EHR|CLINIC|20230615090000||ORU^R01|MSG00002|P|2.5",
        "PID|1||987654321^^^FACILITY^MR||DOE^JANE^M||19750310|F",
        "OBR|1|ORDER123|RESULT456|CBC^COMPLETE BLOOD COUNT|||20230615080000",
        "OBX|1|NM|WBC^White Blood Count||7.5|10^9/L",
        "OBX|2|NM|RBC^Red Blood Count||4.8|10^12/L",
        "OBX|3|NM|HGB^Hemoglobin||14.2|g/dL",
        "",
    ]
)
EDGE = "MSH|^~\\&|A|B\rZZZ|A&B^C|X~Y|p^q&r|\r\nPID|1"


def admission(n: int, patient: str, at: int = 0) -> str:
    return f"MSH|^~\\&|ADT|HOSPITAL|SYS|CENTRAL|{at}||ADT^A01|MSG{n:03d}|P|2.5\rPID|1||{patient}||DOE^JOHN"
