"""Least squares in SQL: elimination on lists, for comparison with the registered models.

``t(target, j, tf, region_id)`` numbers the terms of each target from 1,
``d(target, cell, j, v)`` has their non-zero values and the response as ``j = -1``.
"""

PAIR_TERMS = """
t as (select target, row_number() over (partition by target order by region_id, tf) j, tf, region_id from pairs),
d as (select target, cell, j, cast(e.value*a.value as double) v from t join acc a on a.feature=region_id
    join expr e using (cell) where e.feature=tf
  union all select target, cell, -1, cast(value as double) from (select distinct target from t)
    join expr on feature=target)"""

#: The same terms and the response as z-scores over all cells, zeros included.
SCALED_TERMS = """
t as (select target, row_number() over (partition by target order by region_id, tf) j, tf, region_id from pairs),
zs as (select feature, s1/n m, sqrt((s2-s1*s1/n)/(n-1)) s from emom cross join n
  union all select feature, s1/n, sqrt((s2-s1*s1/n)/(n-1)) from amom cross join n),
used as (select distinct tf feature from t union select distinct target from t union select distinct region_id from t),
z as materialized (select feature, cells.cell, (coalesce(v.value, 0)-m)/s v from used join zs using (feature)
  cross join cells left join (select cell, feature, value from expr union all select cell, feature, value from acc) v
    on v.cell=cells.cell and v.feature=used.feature),
d as (select target, a.cell, j, e.v*a.v as v from t join z a on a.feature=region_id
    join z e on e.feature=tf and e.cell=a.cell
  union all select target, cell, -1, v from (select distinct target from t) join z on feature=target)"""

#: Regions and TFs of the pairs as main effects.
MAIN_TERMS = """
raw as (select distinct target, cast(null as varchar) tf, region_id from pairs
  union select distinct target, tf, null from pairs),
t as (select target, row_number() over (partition by target order by region_id nulls last, tf) j, tf, region_id from raw),
d as (select target, cell, j, cast(value as double) v from t join acc on feature=region_id
  union all select target, cell, j, cast(value as double) from t join expr on feature=tf
  union all select target, cell, -1, cast(value as double) from (select distinct target from t)
    join expr on feature=target)"""


def least_squares(terms: str, result: str) -> str:
    """``result`` selected from ``coef(target, j, est, se)`` and ``fit(target, rsq)``.

    The cross-products are extended by an identity and the response column, and
    every pivot clears its column; the inverse and the solution remain. A term
    whose pivot vanishes is a combination of earlier ones and left out.
    """
    return f"""+with {terms},
rows_ as (select target, cell, cast(j as bigint) j, v from d where v <> 0
  union all select distinct target, cell, cast(0 as bigint), cast(1 as double) from d where v <> 0),
s0 as (select a.target, a.j i, b.j j, sum(a.v*b.v) s from rows_ a join rows_ b
  on a.target=b.target and a.cell=b.cell and a.j<=b.j group by 1, 2, 3),
s1 as (select target, i, j, cast(case when i=0 and j=0 then n else s end as double) s from s0 cross join n),
sy as materialized (select target, i, j, s from s1 union all select target, j, i, s from s1 where i<>j),
ix as (select target, p, unnest(range(0, p+1)) r from (select target, max(j) p from t group by 1)),
base as (select x.target, x.p, x.r, list(coalesce(s, cast(0 as double)) order by c.r) b from ix x join ix c on c.target=x.target
  left join sy on sy.target=x.target and sy.i=x.r and sy.j=c.r group by 1, 2, 3),
wide as (select base.target, p, r, list_concat(list_concat(b,
    list_transform(range(0, p+1), lambda q: case when q=r then cast(1 as double) else cast(0 as double) end)),
    [coalesce(y.s, cast(0 as double))]) w
  from base left join sy y on y.target=base.target and y.i=r and y.j=-1),
m0 as (select target, p, cast(0 as bigint) k, list(w order by r) a, list(w[r+1] order by r) raw,
  cast([] as boolean[]) alias_ from wide group by 1, 2),
rec as (select target, p, k, a, raw, alias_ from m0 union all
  select target, p, k+1, case when a[k+1][k+1] <= 1e-9*raw[k+1] then a
    else list_transform(a, lambda rw, i: case when i=k+1
      then list_transform(a[k+1], lambda x: x/a[k+1][k+1])
      else list_transform(rw, lambda x, q: x-rw[k+1]*a[k+1][q]/a[k+1][k+1]) end) end,
    raw, list_append(alias_, a[k+1][k+1] <= 1e-9*raw[k+1])
  from rec where k<=p),
sol as (select target, p, unnest(range(0, p+1)) j, a, alias_ from rec where k=p+1),
beta as (select target, p, j, a[j+1][2*p+3] est, a[j+1][p+j+2] inv from sol where not alias_[j+1]),
fit as (select b.target, p, n-count(*) df, yy.s-sum(est*coalesce(xy.s, 0)) rss,
    yy.s-my.s*my.s/n tss from beta b cross join n
  join sy yy on yy.target=b.target and yy.i=-1 and yy.j=-1 join sy my on my.target=b.target and my.i=0 and my.j=-1
  left join sy xy on xy.target=b.target and xy.i=b.j and xy.j=-1 group by b.target, p, n, yy.s, my.s),
coef as (select beta.target, j, est, sqrt(inv*rss/df) se from beta join fit using (target))
{result}"""


COEFFICIENTS = """select target, tf, region_id region, round(est, 6)+0.0 estimate, round(se, 6)+0.0 std_err,
  round(est/se, 5)+0.0 statistic from coef join t using (target, j)"""
FITS = "select target, round(1-rss/tss, 6)+0.0 rsq, (select count(*) from pairs where pairs.target=fit.target) nvariables from fit"


#: Start of the linear predictor, mean, working weight, slope of the mean and variance by family.
_FAMILIES = {
    "poisson": ("ln(y+0.1)", "exp(eta)", "mu", "mu", "mu"),
    "binomial": ("ln((y+0.5)/(1.5-y))", "1/(1+exp(-eta))", "mu*(1-mu)", "mu*(1-mu)", "mu*(1-mu)"),
    "Gamma": ("1/y", "1/eta", "mu*mu", "-mu*mu", "mu*mu"),
}


def reweighted(terms: str, family: str, dispersed: bool, rounds: int = 12) -> str:
    """Iteratively reweighted least squares: each round weighs the dense design rows and clears all pivots.

    The matrix of a round has the cross-products, an identity, the right side and
    the raw diagonal, which turns to -1 where the pivot vanishes.
    """
    start, mean, weight, slope, var = _FAMILIES[family]
    return f"""+with {terms},
whole as (select target from d where j=-1 {"and v > 0" if family == "Gamma" else ""} group by 1
  {"having count(*) = (select n from n)" if family == "Gamma" else ""}),
tj as (select distinct target, cast(0 as bigint) j from t join whole using (target) union all select target, j from t join whole using (target)),
x0 as (select g.target, g.cell, list(case when g.j=0 then cast(1 as double) else coalesce(v, cast(0 as double)) end order by g.j) x
  from (select target, j, cell from tj cross join cells) g left join d on d.target=g.target and d.cell=g.cell and d.j=g.j group by 1, 2),
dm as materialized (select x0.target, x, coalesce(v, cast(0 as double)) y from x0 left join d on d.target=x0.target and d.cell=x0.cell and d.j=-1),
rec as (select cast(0 as bigint) it, target, cast([] as double[]) b, cast([] as double[][]) m, cast(0 as double) ps from whole union all
  select it+1, target, list_transform(m, lambda r: case when r[len(r)]=-1 then cast(0 as double) else r[len(r)-1] end), m, ps from (
    select it, target, ps, list_reduce(list_concat([aug], list_transform(range(1, len(aug)+1), lambda k: [[cast(k as double)]])),
      lambda a, kk: case when a[cast(kk[1][1] as int)][cast(kk[1][1] as int)] <= 1e-9*a[cast(kk[1][1] as int)][2*len(a)+2]
        then list_transform(a, lambda rw, i: case when i=cast(kk[1][1] as int)
          then list_transform(rw, lambda e, q: case when q=len(rw) then cast(-1 as double) else e end) else rw end)
        else list_transform(a, lambda rw, i: list_transform(rw, lambda e, q: case when q=len(rw) then e
          when i=cast(kk[1][1] as int) then e/a[i][i]
          else e-rw[cast(kk[1][1] as int)]*a[cast(kk[1][1] as int)][q]/a[cast(kk[1][1] as int)][cast(kk[1][1] as int)] end)) end) m from (
      select it, target, max(ps) ps, list(row_ order by i) aug from (
        select it, target, i, max(ps) ps, list_concat(list_concat(list(s order by j),
          list_transform(range(1, max(p)+1), lambda q: case when q=i then cast(1 as double) else cast(0 as double) end)),
          [max(rhs), max(case when i=j then s end)]) row_ from (
          select it, target, i, j, p, sum(w*x[i]*x[j]) s, sum(w*x[i]*z) rhs, sum(pr) ps from (
            select *, unnest(range(1, p+1)) j from (
              select it, target, x, len(x) p, {weight} w, eta+(y-mu)/({slope}) z, (y-mu)*(y-mu)/({var}) pr, unnest(range(1, len(x)+1)) i from (
                select *, {mean} mu from (
                  select it, rec.target, x, y, case when it=0 then {start} else list_dot_product(x, b) end eta
                  from rec join dm on dm.target=rec.target where it < {rounds}) e1) e2) e3) e4
          group by 1, 2, 3, 4, 5) e5 group by 1, 2, 3) e6 group by 1, 2) e7) e8),
fin as (select target, m, ps, unnest(range(1, len(m)+1)) i from rec where it={rounds}),
rk as (select target, count(*) r from fin where m[i][len(m[i])] <> -1 group by 1),
coef as (select target, i-1 j, m[i][len(m[i])-1] est, sqrt(m[i][len(m)+i]{"*ps/(n-r)" if dispersed else ""}) se
  from fin join rk using (target) cross join n where m[i][len(m[i])] <> -1)
{COEFFICIENTS}"""


def principal_scores(k: int, sweeps: int = 12) -> str:
    """Scores of the columns of the gene correlation matrix by cyclic Jacobi rotations of its covariance."""
    scores = ", ".join(f"round(s[{q}], 6)+0.0 pc_{q}" for q in range(1, k + 1))
    return f"""+with cors as (select x, y, cor from gcor union select y, x, cor from gcor),
ids as (select feature, row_number() over (order by feature) i from emom),
rows_ as (select a.i, list(cast(cor as double) order by b.i) r from cors join ids a on x=a.feature
  join ids b on y=b.feature group by 1),
m0 as (select list(r order by i) m, count(*) n from rows_),
m1 as (select m, n, list_transform(range(1, n+1), lambda c: list_sum(list_transform(m, lambda r: r[c]))/n) mu from m0),
m2 as (select n, list_transform(m, lambda r: list_transform(r, lambda e, c: e-mu[c])) x from m1),
m3 as materialized (select n, x, list_transform(range(1, n+1), lambda p: list_transform(range(1, n+1),
    lambda q: list_sum(list_transform(x, lambda r: r[p]*r[q])))) a,
  list_transform(range(1, n+1), lambda p: list_transform(range(1, n+1),
    lambda q: case when p=q then cast(1 as double) else cast(0 as double) end)) v,
  (select list([p.i, q.i] order by p.i, q.i) from ids p join ids q on p.i<q.i) ij from m2),
rec as (select cast(0 as bigint) k, a, v, ij from m3 union all
  select k+1, list_transform(b, lambda r, h: case when h=i then list_transform(b[i], lambda e, c: co*e-si*b[j][c])
      when h=j then list_transform(b[j], lambda e, c: si*b[i][c]+co*e) else r end),
    list_transform(v, lambda r: list_transform(r, lambda e, c: case when c=i then co*r[i]-si*r[j]
      when c=j then si*r[i]+co*r[j] else e end)), ij
  from (select *, list_transform(a, lambda r: list_transform(r, lambda e, c: case when c=i then co*r[i]-si*r[j]
      when c=j then si*r[i]+co*r[j] else e end)) b from (
    select *, t/sqrt(t*t+1) si, 1/sqrt(t*t+1) co from (
      select *, case when abs(z) < 1e-15 then cast(0 as double) when th < 0 then -1/(sqrt(th*th+1)-th)
        else 1/(th+sqrt(th*th+1)) end t from (
        select *, a[i][j] z, (a[j][j]-a[i][i])/(2*nullif(a[i][j], 0)) th from (
          select *, ij[k%len(ij)+1][1] i, ij[k%len(ij)+1][2] j from rec where k < {sweeps}*len(ij)) s1) s2) s3) s4) s5),
fin as (select a, v from rec where k = {sweeps}*len(ij)),
ev as (select q, a[q][q] e, list_transform(v, lambda r: r[q]) w from fin cross join (select i q from ids) z),
top as (select row_number() over (order by e desc) rk, w from ev qualify rk <= {k}),
sc as (select rk, g, list_sum(list_transform(x[g], lambda e, c: e*w[c])) s from top cross join m3 cross join (select i g from ids) z),
fl as (select rk, case when sum(s*s*s) < 0 then -1 else 1 end f from sc group by 1),
out_ as (select g, list(s*f order by sc.rk) s from sc join fl on fl.rk=sc.rk group by 1)
select feature gene, {scores} from out_ join ids on i=g"""
