"""Precision and recall of the proposals that the trees select, on sentences written by hand and not by the training generator."""

from docsift.llm import pii

# The text, and what of it is disguised personal data.
HELD_OUT = [
    ("For questions please email jane.doe (at) acme-widgets (dot) com before Friday.", "jane.doe (at) acme-widgets (dot) com"),
    ("Our curator can be reached: m.keller[at]museum-bern.ch during opening hours.", "m.keller[at]museum-bern.ch"),
    ("Contact support {at} helpdesk {dot} org if the page does not load.", "support {at} helpdesk {dot} org"),
    ("You can mail to rosa at gardenclub dot net for a catalogue.", "rosa at gardenclub dot net"),
    ("Call our office at (212) 555-0187 between nine and five.", "(212) 555-0187"),
    ("My mobile is 415-555-0132, text me any time.", "415-555-0132"),
    ("Tel. 020 555 0199 for reservations.", "020 555 0199"),
    ("Please phone 0049 301 555 0142 when you arrive.", "0049 301 555 0142"),
    ("Appelez le 06 12 34 56 78 avant midi.", "06 12 34 56 78"),
    ("Mon mobile: 07.98.76.54.32 merci.", "07.98.76.54.32"),
    ("The payment card 4111.1111.1111.1111 was declined.", "4111.1111.1111.1111"),
    ("Charge it to visa 4012/8888/8888/1881 please.", "4012/8888/8888/1881"),
    ("Connections from host 2001:0db8:85a3:08d3:1319:8a2e:0370:7344 were refused.", "2001:0db8:85a3:08d3:1319:8a2e:0370:7344"),
    ("The server 2001:db8::8a2e:370:7334 answered slowly.", "2001:db8::8a2e:370:7334"),
    ("A login from client fe80::1ff:fe23:4567:890a was logged.", "fe80::1ff:fe23:4567:890a"),
    ("Log in from ip fe80::aaaa:bbbb:cccc failed twice.", "fe80::aaaa:bbbb:cccc"),
    ("The order 555-123-4567 shipped on Monday.", ""),
    ("See invoice 202-555-0143 for the details.", ""),
    ("We met at noon at the harbour, dot your i and cross your t.", ""),
    ("The std::vector grows when std::move is not used.", ""),
    ("Their scores were 10 20 30 40 50 in that round.", ""),
    ("Serial 1234 5678 9012 3456 is printed under the lid.", ""),
    ("Version 120.304.5066 fixed the crash.", ""),
    ("Between 1914 1918 1939 the archive is silent.", ""),
    ("Part no 330 555 1200 fits both models.", ""),
    ("The train leaves at 12:45:30 and arrives at 14:05:10.", ""),
    ("The total was 1234567890 units.", ""),
    ("Use a::b::c to name the module.", ""),
]


def test_selected_proposals(spark):
    found = pii.find(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(HELD_OUT)], "doc_id long, text string"))
    hits = wrong = 0
    for r in found.collect():
        text, want = HELD_OUT[r.doc_id]
        got = [text[s.start : s.end] for s in r.spans if s not in r.base]
        hits += want in got if want else 0
        wrong += sum(g != want for g in got)
    recall, precision = hits / sum(bool(w) for _, w in HELD_OUT), hits / max(1, hits + wrong)
    print(f"precision {precision:.2f}, recall {recall:.2f}")
    assert precision >= 0.85
    assert recall >= 0.75
