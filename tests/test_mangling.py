"""Mangled names whose text is known."""

from codeloom.functions.mangling import demangled, is_destructor, with_demangled

KNOWN = {
    "main": "main", "_Z7trythisPv": "trythis(void*)", "_ZN6CircleC2Ev": "Circle::Circle()", "_ZN4BaseC1Ev": "Base::Base()", "_ZN6CircleD0Ev": "Circle::~Circle()", "_ZN6CircleD1Ev": "Circle::~Circle()", "_ZN1a6CircleD2Ev": "a::Circle::~Circle()",
    "_Z1fv": "f()", "_Z3addii": "add(int, int)", "_Z1fPKcRi": "f(char const*, int&)", "_ZNK5Point4distERKS_": "Point::dist(Point const&) const", "_ZN3foo3barE": "foo::bar", "_ZN1N1fEPS_": "N::f(N*)",
    "_ZN5PointpLERKS_": "Point::operator+=(Point const&)", "_ZStlsISt11char_traitsIcEERSt13basic_ostreamIcT_ES5_PKc": "std::basic_ostream<char, std::char_traits<char> >& std::operator<< <std::char_traits<char> >(std::basic_ostream<char, std::char_traits<char> >&, char const*)",
    "_ZNSt6vectorIiSaIiEE9push_backERKi": "std::vector<int, std::allocator<int> >::push_back(int const&)", "_ZNSt6vectorIiSaIiEEC1Ev": "std::vector<int, std::allocator<int> >::vector()", "_Z3maxIiET_S0_S0_": "int max<int>(int, int)",
    "_ZNSolsEi": "std::ostream::operator<<(int)", "_Z1fM": "_Z1fM", "_Z": "_Z", "_ZN1aE": "a", "_Z1gPFivE": "g(int (*)())", "_ZTV6Circle": "vtable for Circle", "_Znwm": "operator new(unsigned long)", "_Z1hA3_i": "h(int [3])", "_ZN12_GLOBAL__N_11fEv": "(anonymous namespace)::f()",
    "_Z1fi.part.0": "f(int).part.0", "_Z1kILi3EEvv": "void k<3>()", "_Z1kILb1EEvi": "void k<true>(int)",
}


def test_known_names():
    assert {k: demangled(k) for k in KNOWN} == KNOWN


def test_over_rows(spark):
    rows = spark.createDataFrame([(1, "_ZN6CircleD0Ev"), (2, None), (3, "_ZN6CircleD0Ev"), (4, "_ZN6CircleC2Ev"), (5, "x~y")], "id int, name string")
    got = with_demangled(rows, "name").withColumn("d", is_destructor("demangled")).collect()
    assert sorted((r.id, r.demangled, r.d) for r in got) == [(1, "Circle::~Circle()", True), (2, None, None), (3, "Circle::~Circle()", True), (4, "Circle::Circle()", False), (5, "x~y", False)]
