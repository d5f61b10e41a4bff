"""The system-call dimension: category, base latency and risk per call name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Calls with measured defaults (name, category, base latency in
# microseconds, risk level 1-5).
MEASURED = """
read io 0.5 1
write io 0.8 1
open file 1.2 2
close file 0.3 1
stat file 0.4 1
fstat file 0.3 1
lstat file 0.4 1
poll sync 5.0 2
lseek file 0.2 1
mmap memory 2.5 3
mprotect memory 1.5 3
munmap memory 1.0 2
brk memory 0.8 2
ioctl device 3.0 3
access file 0.5 1
pipe ipc 1.5 2
select sync 8.0 2
sched_yield process 0.1 1
mremap memory 3.0 3
msync memory 10.0 3
mincore memory 0.5 1
madvise memory 0.4 2
socket network 2.0 3
connect network 50.0 4
accept network 100.0 4
sendto network 5.0 3
recvfrom network 20.0 3
shutdown network 1.0 2
bind network 1.5 3
listen network 0.5 2
clone process 100.0 5
fork process 150.0 5
vfork process 80.0 5
execve process 200.0 5
exit process 50.0 4
wait4 process 500.0 3
kill process 1.0 4
uname system 0.2 1
getpid process 0.1 1
getuid process 0.1 1
getgid process 0.1 1
gettimeofday time 0.1 1
nanosleep time 1000.0 2
futex sync 5.0 3
epoll_wait sync 10.0 2
epoll_create sync 1.0 2
epoll_ctl sync 0.5 2
"""

# Category of further calls. Measured calls keep their own
# category, so `ioctl` stays `device`.
CATEGORY_NAMES = {
    "io": "read write pread64 pwrite64 readv writev sendfile splice tee copy_file_range",
    "file": (
        "open openat close stat fstat lstat newfstatat access faccessat lseek dup dup2 dup3 "
        "fcntl flock chmod fchmod chown fchown rename renameat renameat2 unlink unlinkat mkdir "
        "mkdirat rmdir getcwd chdir fchdir readlink readlinkat statfs fstatfs truncate ftruncate "
        "getdents getdents64 utimensat"
    ),
    "memory": (
        "mmap mmap2 munmap mprotect brk mremap msync mincore madvise mlock munlock shmget shmat "
        "shmctl shmdt"
    ),
    "network": (
        "socket connect accept accept4 bind listen sendto recvfrom sendmsg recvmsg shutdown "
        "setsockopt getsockopt getsockname getpeername socketpair"
    ),
    "process": (
        "clone clone3 fork vfork execve execveat exit exit_group wait4 waitid kill tkill tgkill "
        "getpid getppid gettid getuid geteuid getgid getegid setuid setgid getgroups setgroups "
        "prctl arch_prctl set_tid_address set_robust_list get_robust_list sched_yield "
        "sched_getaffinity sched_setaffinity"
    ),
    "sync": (
        "poll ppoll select pselect6 epoll_create epoll_create1 epoll_ctl epoll_wait epoll_pwait "
        "futex eventfd eventfd2 signalfd signalfd4 timerfd_create timerfd_settime timerfd_gettime"
    ),
    "signal": (
        "rt_sigaction rt_sigprocmask rt_sigreturn rt_sigpending rt_sigtimedwait rt_sigsuspend "
        "sigaltstack signal"
    ),
    "system": "uname sysinfo syslog ioctl getrandom",
    "time": "gettimeofday clock_gettime clock_getres clock_nanosleep nanosleep time times",
    "ipc": "pipe pipe2 msgget msgsnd msgrcv msgctl semget semop semctl",
}

# Defaults of a category (base latency, risk level).
CATEGORY_DEFAULTS = {
    "io": (1.0, 1),
    "file": (0.8, 2),
    "memory": (2.0, 3),
    "network": (10.0, 3),
    "process": (50.0, 4),
    "sync": (5.0, 2),
    "signal": (0.5, 2),
    "system": (0.5, 2),
    "time": (0.2, 1),
    "ipc": (2.0, 2),
    "other": (1.0, 2),
}

# The coarser taxonomy of the live agent.
AGENT_NAMES = {
    "file_io": "read write openat close fstat lstat pread64 pwrite64",
    "memory": "mmap mprotect munmap brk mlock mremap",
    "network": "socket connect send recv setsockopt recvfrom sendto bind",
    "process": "fork clone execve wait4 kill exit_group getpid",
    "scheduling": "select epoll_wait nanosleep poll sched_yield futex",
    "synchronization": "futex sem_wait sem_post pthread_mutex_lock",
    "info": "clock_gettime gettimeofday uname getrusage",
}

OTHER_BASE, OTHER_RISK = CATEGORY_DEFAULTS["other"]


def catalog_rows() -> list[tuple[str, str, float, int, bool]]:
    """(name, category, base, risk, measured): measured calls first, then the rest."""
    rows = {}
    for line in MEASURED.split("\n"):
        if line:
            name, category, base, risk = line.split()
            rows[name] = (name, category, float(base), int(risk), True)
    for category, names in CATEGORY_NAMES.items():
        base, risk = CATEGORY_DEFAULTS[category]
        for name in names.split():
            rows.setdefault(name, (name, category, base, risk, False))
    return list(rows.values())


def agent_rows() -> list[tuple[str, str]]:
    """(name, category) of the agent taxonomy; a name in two takes the smaller one."""
    chosen: dict[str, str] = {}
    for category, names in AGENT_NAMES.items():
        for name in names.split():
            chosen[name] = min(category, chosen.get(name, category))
    return list(chosen.items())


def values_sql() -> str:
    """The catalog as a VALUES list, readable by any SQL engine."""
    return ", ".join(
        f"('{name}', '{category}', CAST({base} AS DOUBLE), {risk}, {str(measured).lower()})"
        for name, category, base, risk, measured in catalog_rows()
    )


def catalog(spark: SparkSession, taxonomy: str = "trace") -> DataFrame:
    """The dimension as a DataFrame (a local relation of fixed size)."""
    if taxonomy == "trace":
        return spark.sql(
            "SELECT * FROM VALUES "
            + values_sql()
            + " AS t(name, category, base, risk, is_measured)"
        )
    if taxonomy == "agent":
        rows = ", ".join(f"('{name}', '{category}')" for name, category in agent_rows())
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, category)")
    raise ValueError(f"unknown taxonomy {taxonomy!r}")
