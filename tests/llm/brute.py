"""Plain versions of the contracts, row by row."""
import re, hashlib, zlib
from collections import Counter, defaultdict
import numpy as np
import xxhash
W8=re.compile(r'[^\x20\x09-\x0D]+'); WA=re.compile(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
low=lambda t: re.sub('[A-Z]',lambda m:m[0].lower(),t)
sha=lambda s: hashlib.sha256(s.encode()).hexdigest()
def op2(rows):
    R=[('assign',re.compile(r'''((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)'''),2,12),('access',re.compile(r'AKIA[A-Z0-9]+'),0,18),('hex',re.compile(r'[0-9a-f]+'),0,16)]
    for i,t in rows:
        sp=[]
        for k,(n,p,g,m) in enumerate(R):
            for x in p.finditer(t or ''):
                if len(x[g])>=m: sp.append((x.start(),k,x.end()))
        sp.sort()
        yield i,[sum(s[1]==k for s in sp) for k in range(3)]+[sha(','.join(f'{R[k][0]}:{a}:{b}' for a,k,b in sp))]
def op4(rows):
    P=[("gnu general public license","gpl"),("apache license","apache"),("cc by","cc-by"),("mit license","mit")]
    for i,t in rows:
        w=WA.findall(low(t or '')); pl=[]; lab=set()
        for p,l in P:
            q=p.split()
            for a in range(len(w)-len(q)+1):
                if w[a:a+len(q)]==q: pl.append(a); lab.add(l)
        yield i,[len(w),len(pl),min(pl) if pl else None,max(pl) if pl else None,','.join(sorted(lab))]
def op5(rows):
    c=Counter(); D=[]
    for i,t in rows:
        w=W8.findall(t or ''); D.append((i,w))
        for a in range(len(w)-34): c[tuple(w[a:a+35])]+=1
    for i,w in D:
        rem=set()
        for a in range(len(w)-34):
            if c[tuple(w[a:a+35])]>1: rem.update(range(a,a+35))
        yield i,[len(w),len(rem),sha(' '.join(x for k,x in enumerate(w) if k not in rem))]
def op6(rows):
    F=[]
    for i,t in rows:
        w=W8.findall(low(t or ''))
        if not w: F.append((i,0)); continue
        sh=[' '.join(w[a:a+4]) for a in range(max(1,len(w)-3))]
        h=[xxhash.xxh64_intdigest(s.encode(),42) for s in sh]
        F.append((i,sum(1<<b for b in range(64) if 2*sum(x>>b&1 for x in h)>len(h))))
    f=np.array([x for _,x in F],np.uint64); n=len(f); lab=np.arange(n)
    adj=[np.flatnonzero(np.bitwise_count(f^x)<=4) for x in f]
    seen=[-1]*n
    for s in range(n):
        if seen[s]<0:
            st=[s]; seen[s]=s
            while st:
                u=st.pop()
                for v in adj[u]:
                    if seen[v]<0: seen[v]=s; st.append(v)
    m={}
    for k in range(n):
        if F[k][0] is not None: m[seen[k]]=min(m.get(seen[k],10**18),F[k][0])
    for k in range(n): yield F[k][0],[f'{F[k][1]:016x}',m.get(seen[k])]
def op9(rows,bench):
    wins=defaultdict(set); 
    for it,t in bench:
        w=WA.findall(low(t or ''))
        if not w: continue
        for a in range(max(1,len(w)-9)): wins[tuple(w[a:a+10])].add(it)
    lens=sorted({len(k) for k in wins})
    for i,t in rows:
        w=WA.findall(low(t or '')); hit=set(); items=set()
        for L in lens:
            for a in range(len(w)-L+1):
                x=wins.get(tuple(w[a:a+L]))
                if x: hit.update(range(a,a+L)); items|=x
        yield i,[len(w),len(hit),len(items),sha(','.join(sorted(map(str,items)))),bool(hit)]


def op8(rows):
    for i, t in rows:
        t = t or ""
        w = W8.findall(t)
        tri = [tuple(w[a : a + 3]) for a in range(len(w) - 2)]
        c, covered = Counter(tri), set()
        for a, x in enumerate(tri):
            if c[x] > 1:
                covered.update((a, a + 1, a + 2))
        lines = [x for x in t.split("\n") if W8.search(x)]
        n = len(w)
        yield i, [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n]
