"""Valid programs count no errors, whatever their literals look like; broken ones count some."""

import pytest

from palimpsest.sources import code as C
from palimpsest.sources.rules import LANGUAGES

VALID = [
    ("cpp", 'auto a = R"(say "hi" (x) "; y)";\nauto b = u8R"--(it\'s )" here)--";\nint n = 1\'000\'000;\nchar q = \'"\';\n'),
    ("rust", 'let a = r#"a"b"#;\nlet b = br##"x"#y"##;\nlet c = \'"\';\nlet d = \'\\\'\';\nfn f<\'a>(x: &\'a str) -> &\'a str { x }\nlet s = "two\nlines";\n'),
    ("javascript", "const a = /\"/g;\nconst b = x.replace(/['\"]/, '');\nconst c = a / b / c;\nif (/[/\"]+/.test(s)) { f(); }\nreturn_(1);\nconst t = `it's ${a} \"`;\n"),
    ("typescript", "const a: RegExp = /it's/;\nfunction f<T>(x: T): T { return x; }\nconst z = a < b;\n"),
    ("tsx", "const a = <div title=\"it's\">Don't {say(\"x\")} \"hi</div>;\nfunction A() {\n  return (\n    <p>\n      It's <b>{x ? <i>you're</i> : null}</b> & more\n      <br />\n    </p>\n  );\n}\nconst c = a < b && b > c;\n"),
    ("javascript", "const a = <>it's</>;\nconst b = <A b={c} />;\nfor (let i = 0; i < n; i++) {}\n"),
    ("ruby", "=begin\nit's a \" note\n=end\nx = <<~TEXT\n  it's \"here\n  TEXT\nfoo(<<-A, 1)\n  don't\n  A\ny = a / b\nz = s =~ /it's/\nt = \"two\nlines\"\n"),
    ("bash", "cat <<EOF\nit's \"here\nEOF\nn=${#a}\nif [ $# -gt 1 ]; then echo 'a\\'; fi\ncase $x in\n  a) echo 1 ;;\n  (b|c) echo \"2\n3\" ;;\n  *) f $(g) ;;\nesac\necho \\\" it # it's a note\nx=${y:-\"}\"}\n"),
    ("lua", "local a = [[it's]]\nlocal b = [==[ ]] it's ]==]\n--[==[ it's\n]==]\nlocal c = t[t[1]]\n"),
    ("csharp", 'var a = @"c:\\";\nvar b = $@"say ""hi"" {x}";\nvar c = """it\'s "here\n""";\n'),
    ("php", "<p>it's</p>\n<?php\n$a = <<<TXT\nit's \"here\nTXT;\n$b = <<<'X'\nit's\nX;\nif ($a) { f(\"two\nlines\"); }\n?>\n<p>don't {</p>\n<?php } ?>\n".replace("<?php } ?>", "<?php g(); ?>")),
    ("zig", "const a =\n    \\\\it's \"here\n    \\\\and { there\n;\n"),
    ("java", 'String a = """\n  it\'s "here {\n  """;\nclass A { char c = \'"\'; }\n'),
    ("go", "var a = `it's \"here`\nvar r = '\"'\n"),
    ("python", 'a = """it\'s "here"""\nb = r"\\d"  # it\'s\n'),
    ("c", "/* it's */ char a = '\\''; // don't\n"),
]
BROKEN = [("cpp", 'auto a = R"(x;\n'), ("javascript", "f(1;\n"), ("javascript", "const a = <div>{x</div>;\n"), ("bash", "cat <<EOF\nx\n"), ("bash", "echo )\n"), ("rust", 'let a = "x;\n'), ("lua", "local a = 'x\n"), ("java", "/* x\n"), ("c", "/*/\n"), ("php", "<?php f(; ?>\n"), ("ruby", "x = <<~A\nb\n"), ("python", "f(\n")]


@pytest.mark.parametrize(("lang", "text"), VALID, ids=[f"{k}-{lang}" for k, (lang, _) in enumerate(VALID)])
def test_valid(lang, text):
    assert C.raw_tree(text, LANGUAGES[lang])[1] == 0


@pytest.mark.parametrize(("lang", "text"), BROKEN, ids=[f"{k}-{lang}" for k, (lang, _) in enumerate(BROKEN)])
def test_broken(lang, text):
    assert C.raw_tree(text, LANGUAGES[lang])[1] > 0


@pytest.mark.parametrize(("lang", "text"), VALID + BROKEN)
def test_tokens_do_not_overlap(lang, text):
    found = C.tokens(text, LANGUAGES[lang])
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False)) and all(text[t.start : t.end] == t.text for t in found)
